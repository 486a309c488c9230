import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_queries_have_names_of_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_core_imports_without_llm():
    """Nothing outside the subpackage llm needs it."""
    code = "import sys; sys.modules['loomline.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p8_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
    for f in (ROOT / "loomline").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "loomline").parts:
            assert "loomline.llm" not in f.read_text(encoding="utf-8"), f


def test_shared_folder():
    """The one the session names; without one, one is set once."""
    from types import SimpleNamespace

    from loomline.session import shared_dir

    named = {}
    context = SimpleNamespace(master="local[2]", getCheckpointDir=lambda: named.get("dir"), setCheckpointDir=lambda d: named.update(dir=f"file:{d}/id"))
    get = lambda conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k, default)), sparkContext=context)
    assert shared_dir(get({"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y" and not named
    first = shared_dir(get({}))
    assert first.startswith("file:") and shared_dir(get({})) == first
    import pytest

    context.master, named["dir"] = "spark://host:7077", None
    with pytest.raises(RuntimeError):
        shared_dir(get({}))  # a temporary folder of one machine is no shared one
