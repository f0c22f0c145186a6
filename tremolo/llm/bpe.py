"""BPE encoding and decoding by a prefix-sharing trie.

The last token of the encoding of a string's prefix is unique, and an encoding is
right exactly when each two neighbouring tokens are what BPE makes of their
concatenation. So distinct words go into a trie; a depth-first walk gives each
node the last token of its prefix (the token that ends there and agrees with the
last token of the shorter prefix before it), and words with a common prefix share
that work. A word's ids are read back along these last tokens.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import Memo, lean, slices, whole_texts

#: Bytes, as counted by ``_weight``, of the chunks that a worker remembers at most; words take an eighth of it besides.
MEMO = 80 << 20
#: Pairs of tokens, and tokens, that it remembers; an entry's size is bounded by the vocabulary.
MEMO_PAIRS, MEMO_TOKENS = 100_000, 8_000

#: Bytes of texts (or ids) that are split into words at a time.
SLICE = 1 << 20

#: White space as the tokenizer's patterns have it (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The word pattern of the tokenizer file, and what it is over lower-case ASCII without white space (fixed values).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
_SPLIT = re.compile(f"[{_SPACE}]+")
#: str.split() also splits at these.
_ONLY_PYTHON = re.compile("[\x1c-\x1f]")


def _weight(word: str, ids: bytes) -> int:
    """Bytes of an entry of a dictionary from a word to its ids: two objects' heads, and the table's share."""
    return 200 + len(ids) + len(word) * (1 if word.isascii() else 4)


class Recent:
    """Ids by word, in two generations of half of ``most`` bytes each: what the younger half looked up or learned
    stays when it becomes the older one, and the older one goes."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> set[str]:
        """Those of ``words`` that aren't known; the others are in ``young`` now."""
        out = set()
        for w in words - self.young.keys():
            ids = self.old.get(w)
            if ids is None:
                out.add(w)
            else:
                self.learn(w, ids)
        return out

    def learn(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.held += _weight(word, ids)

    def turn(self) -> None:
        """Ends a batch: what it used may go from now on."""
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0


class PrefixTrie:
    """Encodes words, given as strings of the byte alphabet, to token ids.

    A word's last symbol carries the vocabulary's end mark, so that it is another
    symbol than the same character inside a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end = end
        own: dict[str, str] = {}  # a token as a string of one character a symbol

        def symbol(token: str) -> str:
            if end and token.endswith(end) and len(token) == len(end) + 1:
                return chr(0xF0000 + ord(token[0]))
            return token

        self.rank: dict[int, int] = {}  # of a pair of tokens, packed
        self.made = array("q", [-1]) * (1 + max(vocab.values()))  # a token's parts and their rank, packed
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            for x in (a, b):
                own.setdefault(x, symbol(x))
            own.setdefault(a + b, own[a] + own[b])
            if self.rank.setdefault(vocab[a] << 20 | vocab[b], rank) == rank:
                if self.made[vocab[a + b]] < 0:
                    self.made[vocab[a + b]] = rank << 40 | vocab[a] << 20 | vocab[b]
        for token in vocab:
            own.setdefault(token, symbol(token))
        self.text = [""] * len(self.made)
        for t, i in vocab.items():
            self.text[i] = own[t]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.tails = {s[k:]: -1 for s in self.text for k in range(1, len(s))}  # -1: only the end of tokens
        self.tails.update((own[t], i) for t, i in vocab.items())
        self.pairs = Memo(self._agree, MEMO_PAIRS)
        self.alone = Memo(lambda t: self._whole(t) == [t], MEMO_PAIRS)
        self.ends = Memo(lambda t: self._edge(t, 0), MEMO_TOKENS)
        self.starts = Memo(lambda t: self._edge(t, 20), MEMO_TOKENS)

    def _whole(self, token: int) -> list[int]:
        """What merging gives for a token's own string: the lowest rank, leftmost first, until none is left."""
        out = [self.tails[s] for s in self.text[token]]
        while len(out) > 1:
            best = min(((self.rank[a << 20 | b], k) for k, (a, b) in enumerate(zip(out, out[1:])) if a << 20 | b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [self.tails[self.text[out[k]] + self.text[out[k + 1]]]]
        return out

    def _edge(self, token: int, shift: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge (shift 0: the last part's, 20: the first's) while the token is merged, and the rank at which each is used up."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            parts = self.made[token]
            if parts < 0:
                return out[::-1]
            token, until = parts >> shift & 0xFFFFF, parts >> 40

    def _agree(self, key: int) -> bool:
        """Whether no merge across the border of two tokens comes before those inside them."""
        left, right, rank = self.ends[key >> 20], self.starts[key & 0xFFFFF], self.rank
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = rank.get(x << 20 | y)
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until <= y_until:
                if x_until == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each distinct word's ids as little-endian unsigned 32-bit integers.

        The trie is kept flat: sorted words, each branching off the one before where their
        common prefix ends, which is the depth-first order of its nodes. ``state`` holds the last
        token of each prefix on the path from the root, so a shared prefix is computed once.
        """
        done: dict[str, bytes] = {}
        tails, pairs, alone, packed, text = self.tails, self.pairs, self.alone, self.packed, self.text
        state: list[int] = [-1]
        before = ""
        for path, word in sorted((w[:-1] + chr(0xF0000 + ord(w[-1])) if self.end else w, w) for w in words if w):
            depth, most = 0, min(len(path), len(before))
            while depth < most and path[depth] == before[depth]:
                depth += 1
            before = path
            if len(state) <= len(path):
                state.extend([-1] * (len(path) - len(state) + 1))
            while depth < len(path):
                depth += 1
                n = 0
                while True:
                    n += 1
                    token = tails.get(path[depth - n : depth]) if n <= depth else None
                    if token is None:
                        raise ValueError(f"no token of the vocabulary ends {path[:depth]!r}")
                    if token >= 0 and (alone[token] if n == depth else pairs[state[depth - n] << 20 | token]):
                        break
                state[depth] = token
            out = []
            while depth:
                token = state[depth]
                out.append(packed[token])
                depth -= len(text[token])
            out.reverse()
            done[word] = b"".join(out)
        return done


class Codec:
    """A tokenizer file's encoder and decoder: its own normaliser and word pattern, our merges."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        # The library's normaliser and word pattern are all that is used of it: its own vocabulary stays empty.
        empty = Tokenizer.from_str(json.dumps(parsed | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalizer, self.splitter = empty.normalizer, empty.pre_tokenizer
        # The file's pattern over lower-case ASCII, if it is the one that we know.
        self.plain = re.compile(_PLAIN) if _PATTERN in json.dumps(parsed["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") else None
        model = parsed["model"]
        if model["type"] != "BPE" or parsed.get("decoder") or model.get("continuing_subword_prefix"):
            raise ValueError("only BPE files with a plain decoder are supported")
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens with matching options are not supported")
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.trie = PrefixTrie(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.chunks, self.words = Recent(MEMO), Recent(MEMO // 8)

    def remember(self, most: int) -> Codec:
        self.chunks.most, self.words.most = most, most // 8
        return self

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _SPLIT.split(text) if c] if _ONLY_PYTHON.search(text) else text.split()

    def _pieces(self, text: str) -> list[list[str]]:
        """Chunks between special tokens; a special token is a list of its own, marked by its place."""
        if self.parts is None or not self.parts.search(text):
            return [self._chunks(text)]
        return [[p] if k % 2 else self._chunks(p) for k, p in enumerate(self.parts.split(text))]

    def _learn(self, chunks: set[str]) -> None:
        split: dict[str, list[str]] = {}
        odd = []
        for c in chunks:
            if not c.isascii():
                odd.append(c)
            elif c.isalpha():
                split[c] = [c.lower()]
            else:
                split[c] = self.plain.findall(c.lower()) if self.plain and c.isprintable() else [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(c))]
        # The others go through the file's own normaliser and pattern, which treat chunks between spaces alike.
        joined = self.normalizer.normalize_str(" ".join(odd))
        pieces = self.splitter.pre_tokenize_str(joined)
        at = k = 0
        for c, form in zip(odd, joined.split(" ")):
            at += len(form)
            words = split[c] = []
            while k < len(pieces) and pieces[k][1][1] <= at:
                words.append(pieces[k][0])
                k += 1
            at += 1
        new = self.words.missing({w for ws in split.values() for w in ws})
        for w, ids in self.trie.encode(new).items():
            self.words.learn(w, ids)
        known = self.words.young
        for c, ws in split.items():
            self.chunks.learn(c, known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]))
        self.words.turn()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self._pieces(t or "") for t in texts]
        self._learn(self.chunks.missing({c for pieces in split for k, piece in enumerate(pieces) if k % 2 == 0 for c in piece}))
        get = self.chunks.young.__getitem__
        out = [b"".join(b"".join(map(get, piece)) if k % 2 == 0 else self.special[piece[0]] for k, piece in enumerate(pieces)) for pieces in split]
        self.chunks.turn()
        return out


class Tokens:
    """Decoding needs the tokens alone: they are joined by a space."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        if parsed.get("decoder"):
            raise ValueError("only files with a plain decoder are supported")
        self.tokens = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}

    def decode(self, rows: list[bytes | None]) -> list[str]:
        return [" ".join(map(self.tokens.__getitem__, memoryview(ids or b"").cast("I"))) for ids in rows]


_made: dict[tuple, Codec | Tokens] = {}


def _kept(kinds: tuple[type, ...], spec: str) -> list[Codec | Tokens]:
    """A worker keeps what its last call used, one of each kind for a file."""
    keys = [(kind, hash(spec)) for kind in kinds]
    for key in [k for k in _made if k not in keys]:
        del _made[key]
    for key in keys:
        if key not in _made:
            _made[key] = key[0](spec)
    return [_made[key] for key in keys]


def _added(df: DataFrame, column: str, path: str, outs: dict[str, str], kinds: tuple[type, ...], each: Callable, size: int = SLICE) -> DataFrame:
    """``df`` with the columns ``outs`` (name to type; any that it had are replaced), which ``each`` makes from a slice of ``column``, ``size`` bytes at a time."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [F.col(f"`{c}`") for c in df.columns if c not in outs]
    source = df.select(*rest, F.col(f"`{column}`").alias("_tremolo_in"))
    schema = source.drop("_tremolo_in").schema
    for name, kind in outs.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _kept(kinds, shared.value)
        for whole in batches:
            for batch in slices(whole, "_tremolo_in", size):
                made = each(batch.column(batch.num_columns - 1).to_pylist(), *tools)
                arrays = [pa.array(x, pa.binary() if kind == "binary" else pa.string()) for x, kind in zip(made, outs.values())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *outs])

    return whole_texts(source).mapInArrow(lean(run), schema)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids``: the whole text's token ids, as BINARY of little-endian
    unsigned 32-bit integers (what the tokenizer library gives without added special tokens).

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows
    each get theirs; an empty table stays empty; a column named like ``ids`` is replaced,
    others pass through unchanged. The tokenizer file is read on the driver and
    broadcast: its size is fixed.
    """
    return _added(df, text, path, {ids: "binary"}, (Codec,), lambda texts, codec: [codec.encode(texts)])


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text``: the ids' tokens, special ones too, joined by a space.

    Null and empty ids give an empty text; ids that the file lacks raise KeyError.
    """
    return _added(df, ids, path, {text: "string"}, (Tokens,), lambda rows, tokens: [tokens.decode(rows)])


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", memo: int = MEMO) -> DataFrame:
    """``df`` with the columns ``ids`` and ``decoded``: ``bpe_encode`` and ``bpe_decode`` of its ids, by one pass of one worker.

    ``memo``: bytes of what a worker remembers of words that it has met; less takes longer.
    """

    def each(texts: list, codec: Codec, tokens: Tokens) -> list[list]:
        rows = codec.remember(memo).encode(texts)
        return [rows, tokens.decode(rows)]

    size = max(1 << 18, min(SLICE, memo // 16))
    return _added(df, text, path, {ids: "binary", decoded: "string"}, (Codec, Tokens), each, size)
