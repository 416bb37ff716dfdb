"""The pipeline: each stage on its own input, against what the operators' own tests have as plain models."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from cloakwork.llm import mixing, toxicity
from cloakwork.llm.common import remainder

from .test_models import check_packing, plain_components

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == docs.columns
    rows = [[tuple(r) for r in df.select("doc_id", "text").collect()] for df in seen[:-1]]

    machine = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), remainder("doc_id", 3) != 1)
    low = {r["id"] for r in toxicity.scores(docs, machine).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r[0] in low)

    best = {}
    for i, t in rows[1]:
        key = t.encode().lower()
        best[key] = max(best.get(key, i), i)
    assert sorted(i for i, _ in rows[2]) == sorted(best.values())
    assert sorted(i for i, _ in rows[3]) == [i for i, _, _, kept in plain_components(rows[2]) if kept]
    times = Counter(i for i, _ in rows[4])
    assert set(times) == {i for i, _ in rows[3]} and max(times.values()) <= mixing.REPEATS
    tokens, sequences = check_packing(rows[4], seen[-1].collect())
    assert sequences <= -(-tokens // 2048) * 1.05 + 1


def test_nothing_else_imports_this():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "cloakwork.llm" or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
