"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import struct
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import base, secrets
from tremolo.llm import mix, toxicity
from tremolo.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns, name
        seen.append(docs.collect())
    first, calm, single, clean, mixed, encoded = seen
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert sorted(calm) == sorted(r for r in first if score[r.doc_id] < 0.3)
    assert len(calm) < len(first)
    assert {r.doc_id for r in single} == {c for *_, c in brute([(r.doc_id, r.text) for r in calm])} and set(single) <= set(calm)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} and len(clean) == len(single)
    before = {r.doc_id: r.text for r in single}
    assert all(r.text == before[r.doc_id] for r in clean if not base(before[r.doc_id]) and not secrets(before[r.doc_id]))
    assert not any(s for r in clean for s in base(r.text) + secrets(r.text)) and any(base(t) for t in before.values())
    assert set(mixed) <= set(clean)
    own, taken = defaultdict(int), defaultdict(int)
    for rows, into in ((clean, own), (mixed, taken)):
        for r in rows:
            into[r.source] += len(r.text.split())
    names = sorted(own)
    aim = mix.targets([own[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    assert all(abs(taken[s] - a) < 0.02 * own[s] for s, a in zip(names, aim))
    library = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in clean}
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)
    assert all(bytes(r.ids) == struct.pack(f"<{r.n_tokens}I", *ids[r.doc_id]) for r in encoded)
    assert all(r.decoded_sha256 == hashlib.sha256(library.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest() for r in encoded)
