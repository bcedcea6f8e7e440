"""The driver's contract, and that the corpus part can be taken away."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_oracles():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    if entry.HAS_LLM:
        assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert ("pipeline" in queries) == entry.HAS_PIPELINE


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1


def run(code_or_args, cwd):
    args = ["-c", code_or_args] if isinstance(code_or_args, str) else code_or_args
    return subprocess.run([sys.executable, *args], cwd=cwd, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


COUNT = "import __spark_entry__ as e; assert not e.HAS_LLM and not e.HAS_PIPELINE and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); e.oracle_sql(); print(len(e.queries()))"


def test_the_rest_works_without_the_corpus_part(tmp_path):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    done = run(COUNT, tmp_path / "repo")
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr
    if "ATTESTOR_NESTED" not in os.environ:  # the copy's own run of this file need not copy again
        os.environ["ATTESTOR_NESTED"] = "1"
        try:
            collected = run(["-m", "pytest", "tests", "-q", "--collect-only"], tmp_path / "repo")
            assert collected.returncode == 0 and "error" not in collected.stdout.lower().splitlines()[-1], collected.stdout
            done = run(["-m", "pytest", "tests/test_entry.py", "tests/test_scoring.py", "-q", "-x", "-k", "not without"], tmp_path / "repo")
            assert done.returncode == 0, done.stdout
        finally:
            del os.environ["ATTESTOR_NESTED"]


def test_leftover_folders_and_missing_libraries_do_not_matter(tmp_path):
    """A folder without sources, and corpus operators whose libraries are missing."""
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse"))
    (tmp_path / "repo" / "attestor" / "llm" / "__pycache__").mkdir(parents=True)
    assert run(COUNT, tmp_path / "repo").returncode == 0
    (tmp_path / "repo" / "attestor" / "llm" / "__init__.py").write_text("")
    (tmp_path / "repo" / "attestor" / "llm" / "queries.py").write_text("import no_such_library\n")
    assert run(COUNT, tmp_path / "repo").returncode == 0


def test_nothing_else_imports_the_corpus_part():
    for folder, _, names in os.walk(os.path.join(HERE, "attestor")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "attestor.llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
