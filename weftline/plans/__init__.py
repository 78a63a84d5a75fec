"""Plan helpers: sessions, staging and registered queries."""
