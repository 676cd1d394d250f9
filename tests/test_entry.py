import importlib

import __spark_entry__ as entry


def test_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert {"p1_found", "p7_found"} <= q.keys() and o.keys() <= q.keys()


def test_rest_does_not_import_the_optional_part():
    import pathlib

    for p in pathlib.Path(importlib.import_module("threadmill").__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "threadmill.llm" not in p.read_text(), p


def test_a_missing_library_is_no_missing_subpackage(monkeypatch):
    import pytest

    real = importlib.import_module

    def broken(missing):
        def load(name, *a):
            if name in entry._OPTIONAL:
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *a)

        return load

    monkeypatch.setattr(entry.importlib, "import_module", broken("threadmill.llm"))
    assert "p1_found" in entry.queries() and "p2_found" not in entry.queries()
    monkeypatch.setattr(entry.importlib, "import_module", broken("ahocorasick"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from threadmill.session import ensure_checkpoint_dir

    set_to = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=set_to.append, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
    session.conf = SimpleNamespace(get=lambda key, default: "file:///shared")
    ensure_checkpoint_dir(session)
    assert set_to == ["file:///shared"]
