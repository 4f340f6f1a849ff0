import subprocess
import sys

import __spark_entry__


def test_import_needs_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = map(int, out.stdout.split())
    assert 60 <= oracles <= queries


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_operators():
    hide = "import sys; sys.modules['ledgermill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[:2] == 'op' and k[2].isdigit() or k == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", hide], capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[]", out.stdout + out.stderr


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"metric", "label_from", "label_to", "growth_pct"}
