"""Fill-in-the-middle: texts cut at token borders and put in another order.

A kernel works on all texts of an Arrow batch at once, on its UTF-8 bytes: a lookup table classes
bytes, a mask of neighbouring bytes marks where tokens begin, cumulative sums that start again at
each text number them, and one binary search finds the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import lean, slices, whole_texts

#: What marks the parts of an output, and the white space that a token begins with (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Of 100 texts so many are cut, and of 100 that are cut so many have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2^32 by document: the first 8-digit groups of the hex sha256 of ``seed:doc_id``. A null id counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and the border of each text in them (one more than texts)."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    borders = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * width().itemsize).astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def tokens(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running number of token beginnings up to each byte, tokens of each text).

    A token is white space with the word after it, or what white space ends a text: one begins at each
    text's first byte and at each white space after another character.
    """
    space = _IS_SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[borders[:-1][borders[:-1] < borders[1:]]] = True  # a text's first byte, whatever the text before it ends with
    upto = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.concatenate([[0], upto])[borders]
    return upto, np.diff(before)


def cuts(upto: np.ndarray, counts: np.ndarray, borders: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte before which ``k`` tokens of each text stand (its end, if it has no more)."""
    base = np.concatenate([[0], upto])[borders[:-1]]
    return np.where(k < counts, np.searchsorted(upto, base + k + 1), borders[1:])


def marked(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    out = np.zeros(len(borders) - 1, bool)
    at = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8))) if len(data) > 2 else np.zeros(0, int)
    text = np.searchsorted(borders, at, "right") - 1
    out[text[at + 2 < borders[text + 1]]] = True
    return out


def arrange(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) of an array of texts and their four draws."""
    texts = pc.fill_null(texts, "")
    data, borders = layout(texts)
    upto, n = tokens(data, borders)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    first, second = (cuts(upto, n, borders, f(a, b)) for f in (np.minimum, np.maximum))
    plain = (n == 0) | (h[2] % 100 >= rate) | marked(data, borders)
    spm = h[3] % 100 < suffix_first
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    # The three parts of all texts as one array over the same bytes.
    edges = np.append(np.stack([borders[:-1], first, second], 1).ravel(), borders[-1]).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
    join = lambda *columns: pc.binary_join_element_wise(*(pa.scalar(c, pa.large_string()) if isinstance(c, str) else c for c in columns), pa.scalar("", pa.large_string()))
    form = np.where(plain, 0, np.where(spm, 1, 2))
    output = pc.choose(
        pa.array(form), texts.cast(pa.large_string()), join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    )
    chars = lambda lo, hi: pa.array(points[hi] - points[lo], mask=plain)
    named = pa.array(["plain", "spm", "psm"]).take(pa.array(form))
    return [pa.array(n.astype(np.int64)), named, chars(borders[:-1], first), chars(first, second), output.cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n, form, prefix_chars, middle_chars and output; those of its columns that have these names give way.

    Two draws of a document name the tokens after which its prefix and its middle end. Its form is plain
    (output is the text, no parts) where a third draw says so, where the text is empty or holds a mark;
    else spm, suffix first, or psm, by a fourth. Null and empty texts count as empty: n is 0, the form
    plain, the output empty. A null id draws as an empty one; repeated rows each get the same result;
    texts of any length are cut whole; an empty table gives no rows; clashing names aren't read.
    """
    made = [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [c for c in docs.columns if c not in made]
    # Columns go through the kernel by place: names with dots can't.
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.array(*draws(F.col("doc_id"), seed)).alias("_h"))
    schema = source.drop("_h").schema
    for field in SCHEMA.split(", "):
        schema = schema.add(*field.split())
    text = f"_{kept.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                h = batch.column("_h").flatten().to_numpy().reshape(-1, 4)
                columns = arrange(batch.column(text), list(h.T), rate, suffix_first)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, schema.names)

    return whole_texts(source).mapInArrow(lean(run), schema).toDF(*kept, *made)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
