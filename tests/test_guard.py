"""Without the training-data subpackage and the pipeline everything else imports and registers."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_stands_alone(tmp_path):
    shutil.copytree(os.path.join(ROOT, "corpusloom"), tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'chunk_greedy_200' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    # a folder that is left with nothing to import, or with a part that can't be, is as good as none
    (tmp_path / "corpusloom" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    (tmp_path / "corpusloom" / "llm" / "registry.py").write_text("import no_such_module_anywhere\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "corpusloom")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert "llm" not in text.read()
