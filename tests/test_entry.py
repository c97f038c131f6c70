"""The registry works without the optional subpackage; this twin of a check stays when that one's tests go."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_without_the_subpackage_and_pipeline(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("hushframe", "corpus_pipeline.py", "__spark_entry__.py", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "hushframe").mkdir()
    for name in os.listdir(f"{ROOT}/hushframe"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/hushframe/{name}", tmp_path / "hushframe" / name)
    with open(f"{ROOT}/__spark_entry__.py") as source:
        (tmp_path / "entry.py").write_text(source.read())
    code = "import entry; q = entry.queries(); assert 'risk_summary' in q and 'pipeline' not in q; assert set(entry.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
