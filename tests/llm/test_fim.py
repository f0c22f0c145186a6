"""Fill-in-the-middle against plain Python and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tremolo.llm import fim
from tremolo.llm.queries import op12_fim

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    toks = [m[0] for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    n = len(toks)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(toks[:a]), "".join(toks[a:b]), "".join(toks[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_fim(spark, SF).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, sha(out))
        assert r.restored_sha256 == sha(docs[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


TEXTS = [None, "", " ", "a", " a", "a ", "a b ", "\t\n a\x0b\x0cb\r\r c", "é 漢字 x y 𝒳𝒳 z", "a<P>b", "<S>", "x <M", "> <P", "<", "<p> <Q>", "\x1c a\x1db", "w " * 5000, "x" * 70000, " " * 300, "a\x00b c"]


def test_texts_of_all_kinds(spark):
    rows = [(40 * k + i, t) for k, t in enumerate(TEXTS) for i in range(40)] + [(None, "a b c d"), (None, None), (7, "a b c"), (7, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as n", "1 as form", "doc_id + 1 as `odd.name`")
    made = fim.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "odd.name", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == sorted(map(repr, [(i, t, *brute(i, t)) for i, t in rows]))
    assert all(r.back == (r.text or "") for r in got)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_kernel_on_slices_of_a_batch():
    """Borders between texts begin tokens and end marks; slices start amid a buffer."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n<PSM>é𝒳") for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", "<", "P>"]
    h = [np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(4)]
    for kind in (pa.string(), pa.large_string()):
        for lo, hi in ((0, len(texts)), (1000, 1700), (1700, 1700)):
            got = fim.arrange(pa.array(texts, kind)[lo:hi], [x[lo:hi] for x in h], rate=100)
            for k, (n, form, p, m, out) in enumerate(zip(*(c.to_pylist() for c in got)), lo):
                t = texts[k] or ""
                toks = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
                a, b = sorted(int(h[i][k]) % (len(toks) + 1) for i in (0, 1))
                assert n == len(toks) and (form == "plain") == (not t or bool(re.search("<[PSM]>", t)))
                if form != "plain":
                    assert (p, m) == (len("".join(toks[:a])), len("".join(toks[a:b])))
                    assert sorted(re.split("<[PSM]>", out)[1:]) == sorted(["".join(toks[:a]), "".join(toks[a:b]), "".join(toks[b:])])
