"""The driver contract, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus(tmp_path):
    code = "import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'pagerank_fixed' in e.queries() and not any(x.startswith('op') and x[2].isdigit() for x in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_some_queries_match_sql(spark):
    import duckdb

    from graphloom import queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("degrees", "project_types", "triangle_count", "cdlp", "k_core", "sssp"):
        df = queries.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        rel = c.sql(queries.SQL[name])
        assert sorted(rel.columns) == cols
        want = rel.select(", ".join(cols)).fetchall()
        assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want)), name
