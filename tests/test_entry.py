"""What the entry module registers without the parts that may be missing."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def registered(folder, before=""):
    code = f"import sys\n{before}\nimport __spark_entry__ as e\nprint(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), sum(q.startswith('op') for q in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": folder})
    return found.stdout.split() if not found.returncode else found.stderr


def copied(tmp_path):
    for name in ("groundloom", "__spark_entry__.py", "corpus_pipeline.py"):
        place = os.path.join(HERE, name)
        if os.path.isdir(place):
            shutil.copytree(place, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(place):
            shutil.copy(place, tmp_path / name)
    return str(tmp_path)


def test_without_the_corpus_operations(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(tmp_path / "groundloom" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    found = registered(folder)
    assert int(found[0]) > 50 and found[1:] == ["[]", "0"]


def test_without_the_tokenizers_files(tmp_path):
    hidden = "import importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda name, *a: None if name == 'public_tokenizers' else real(name, *a)"
    found = registered(copied(tmp_path), hidden)
    assert int(found[0]) > 50 and found[1:] == ["[]", "0"]
