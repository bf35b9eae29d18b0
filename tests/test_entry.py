"""The driver contract, also without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "rank", "distance", "score"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_imports_without_the_subpackage(tmp_path):
    for name in ("marginalia", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "marginalia" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries()), list(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_a_missing_library_takes_only_its_queries(tmp_path):
    if not (ROOT / "marginalia" / "llm").exists():
        return
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and {'op1_minhash', 'op10_html'} <= set(q) and not {'op4_decontaminate', 'op8_secrets', 'pipeline'} & set(q) and set(e.oracle_sql()) <= set(q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "marginalia").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "marginalia").parts:
            assert "marginalia.llm" not in p.read_text(), p
        assert "corpus_pipeline" not in p.read_text(), p
