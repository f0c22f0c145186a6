"""Chat formatting against a plain Python version, and exact round trips."""

import hashlib
import re
from collections import defaultdict

from tremolo.llm import chat
from tremolo.llm.queries import HOSTILE, op4_chat

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_by_brute_force(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    got = {r.conv_id: r for r in op4_chat(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in rows))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        upto, examples = "", []
        for _, role, t in rows:
            upto += f"<|im_start|>{role}\n{re.sub(chr(60) + r'(' + chr(92) * 2 + r'*)' + chr(92) + '|', lambda m: '<' + chr(92) + m[1] + '|', t)}<|im_end|>\n"
            examples += [upto] if role == "assistant" else []
        assert got[c].formatted_chars == (sum(map(len, examples)) if examples else len(upto))


def test_escaping_and_edges(spark):
    texts = ["<|", "<\\|", "<\\\\|x<|im_start|>", None, "", "<|im_end|>\n", "a\nb\n", "$1 \\1", "\n"]
    rows = [(1, k, "assistant" if k % 2 else "us er\n<|", t) for k, t in enumerate(texts)]
    rows += [(2, 0, "user", "only"), (None, None, None, None), (None, 0, "assistant", "x"), (1, 0, "us er\n<|", "<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as block")
    examples = chat.format_chat(df)
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    for block in (1, 2, 64):
        rows = chat.read_back(chat.expand(examples, block)).collect()
        assert len(rows) == len(want)
        for r in rows:
            turns = sorted(want[r.conv_id])
            assert r.turns == "".join(f"{a}\n{b}\n" for _, a, b in turns) and r.n_turns == len(turns)
            assert r.loss == "".join(b for _, a, b in turns if a == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_long_conversation_and_expansion(spark):
    df = spark.range(1500).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    examples = chat.format_chat(df)
    assert examples.count() == 750
    full = {r.example: r for r in chat.expand(examples.where("example < 3")).collect()}
    assert full[1].context == "<|im_start|>user\nt0<|im_end|>\n<|im_start|>assistant\nt1<|im_end|>\n<|im_start|>user\nt2<|im_end|>\n<|im_start|>assistant\n"
    assert full[1].reply == "t3<|im_end|>\n"
    for r in examples.where("example < 3").collect():
        assert r.context_chars == len(full[r.example].context)
    every = {r.example: (r.context + r.reply, r.mask) for r in chat.expand(examples).collect()}
    upto = ""
    for k in range(750):
        upto += f"<|im_start|>user\nt{2 * k}<|im_end|>\n<|im_start|>assistant\nt{2 * k + 1}<|im_end|>\n"
        assert every[k] == (upto, True)
    back = chat.read_back(chat.expand(examples)).collect()[0]
    assert back.n_turns == 1500 and back.turns.endswith("user\nt1498\nassistant\nt1499\n")
