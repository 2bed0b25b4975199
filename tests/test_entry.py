import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_and_oracles():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 200


def test_without_the_optional_folders(tmp_path):
    """A copy without the training-data folders and the pipeline still imports and lists its queries."""
    (tmp_path / "arborlake").mkdir()
    for p in REPO.glob("arborlake/*"):
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "arborlake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not [n for n in q if n.startswith('op') or n == 'pipeline'], q"
    subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK", "HOME"))})


def test_nothing_else_imports_the_optional_folder():
    for p in REPO.glob("arborlake/**/*.py"):
        if "llm" not in p.parts:
            assert "arborlake.llm" not in p.read_text(), p
