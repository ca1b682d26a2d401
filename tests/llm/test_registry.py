import re
from pathlib import Path

import __spark_entry__
import corpus_pipeline
from lumenfold.llm import registry

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()]
    assert numbers == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scan", "sentencepiece"]


def test_nothing_else_imports_the_operators():
    for p in (ROOT / "lumenfold").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lumenfold").parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
