"""The entry module without what only the training-data queries need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(hidden: str | None) -> tuple[set, set]:
    """Queries and oracles that the entry module gives when the module ``hidden`` cannot be imported."""
    code = (f"import sys; sys.modules[{hidden!r}] = None if {hidden!r} != 'None' else sys.modules.get('None')\n"
            "import __spark_entry__ as e; print('NAMES', *e.queries()); print('ORACLES', *e.oracle_sql())")
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    found = {x.split()[0]: set(x.split()[1:]) for x in out.stdout.splitlines() if x.startswith(("NAMES", "ORACLES"))}
    return found["NAMES"], found["ORACLES"]


def test_a_missing_library_costs_only_its_queries():
    from tessera.plans import QUERIES, load_all
    load_all()
    rest = set(QUERIES)
    for hidden in ("public_tokenizers", "tessera.llm.queries", "corpus_pipeline"):
        own, oracles = names(hidden)
        assert own == rest and oracles <= rest, hidden
    assert names("None")[0] >= rest
