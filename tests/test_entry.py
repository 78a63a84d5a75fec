"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from weftline.plans import catalog


def test_every_query_of_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "prefix_index", "n_messages", "prefix_sha256"] and df.count() > 0


def test_import_without_the_optional_modules(tmp_path):
    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
    (tmp_path / "weftline" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
    # a broken import inside is not swallowed
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode


def test_names_of_columns_equal_those_of_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    from weftline.plans import catalog_runs  # noqa: F401

    for name in ("p12_drafts", "p13_reviews", "p14_records", "r7_run_replay", "j12_soft_replay", "w7_jobs", "w10_split_allocation", "sc6_manifest"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        found = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in found.description]
        rows = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        key = lambda r: sorted((k, str(v)) for k, v in r.items())
        assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, rows)), name
