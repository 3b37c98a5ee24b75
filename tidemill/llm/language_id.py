"""Language identification by compression: a text is cut into blocks, each block is compressed by Zstandard
with every language's raw-content dictionary, and the language of the smallest sum is chosen. Texts and
dictionaries are lower-cased, and runs of other than letters become a space.

The dictionaries are the only thing learnt. Each holds at most DICT_BYTES from at most DICT_DOCS labelled
whole texts of its language, picked by a hash of the id; this bounded sample is the classifier's fit. All texts
are classified whole.

Null texts and texts without a letter are `und` with score 0. A prediction whose margin between the two
smallest sums is under MARGIN of the smallest is marked unreliable. Equal sums: the language with more labelled texts.
With no labelled row all texts are `und`. Very long texts are compressed whole, block by block. A null doc_id is learnt
from like any other and `held_out` is null for it. Repeated rows stay; an empty table gives an empty result; columns of docs by the new names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, trimmed

DICT_DOCS = 64
DICT_BYTES = 100_000
BLOCK = 4_000
LEVEL = 6
MARGIN = 0.01
NOT_LETTERS = re.compile(r"[\W\d_]+").sub


def letters(text: str) -> bytes:
    return NOT_LETTERS(" ", text.lower()).encode()


def sample(labelled: DataFrame, text: str, lang: str, docs: int = DICT_DOCS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary's content for each language: the pieces of its hashed-first texts, up to the bounds."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    space = 1 << 30
    # a share of the hashes that holds some twice the wanted rows of each language, so that what comes back is bounded
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(space, math.ceil(space * 2.0 * docs / n) + space // 1000 * (n < 100_000)))])
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("dictionary")), F.lit(space))
    got: dict[str, list[tuple[int, int, str]]] = {}
    for r in rows.filter(h < share[F.col(lang)]).select(lang, h.alias("h"), "doc_id", text).toLocalIterator():
        keep = got.setdefault(r[0], [])
        keep.append((r[1], r[2], r[3]))
        if len(keep) > 2 * docs:
            keep[:] = sorted(keep)[:docs]
    out = {}
    for k, v in sorted(got.items(), key=lambda x: (-counts[x[0]], x[0])):
        chosen, room = [], size
        for t in (letters(t) for *_, t in sorted(v)[:docs]):
            if len(t) < room:
                chosen.append(t)
                room -= len(t) + 1
        out[k] = b"\n".join(chosen) or min((letters(t) for *_, t in v), key=len)[:size]
    return out


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = list(content)
        self.level = level
        dicts = [zstandard.ZstdCompressionDict(content[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k in self.names]
        for d in dicts:
            d.precompute_compress(level=level)
        self.coders = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]

    def sizes(self, text: bytes, block: int = BLOCK) -> list[int]:
        """Compressed bytes of the whole text, by language."""
        blocks = [text[i : i + block] for i in range(0, len(text), block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        if not text or not self.names or not (any(map(str.isalpha, text[:400])) or any(map(str.isalpha, text))):
            return "und", 0.0, False
        sizes = self.sizes(letters(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        gap = 1.0 if len(sizes) == 1 else (sizes[order[1]] - best) / best
        return self.names[order[0]], min(1.0, 1.0 - math.exp(-gap / 0.05)), gap >= margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, rising with the margin) and reliable (false: rejected for a narrow margin)."""
    small_batches(docs.sparkSession)
    key = hashlib.sha256(repr(dictionaries.items()).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.drop("lang_pred", "score", "reliable")
    at = rows.columns.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["lang_pred string, score double, reliable boolean"])
    names = [*rows.columns, "lang_pred", "score", "reliable"]

    def run(batches):
        predict = kept(key, lambda: Classifier(sent.value)).predict
        for batch in batches:
            said = [predict(t) for t in batch.column(at).to_pylist()]
            extra = [pa.array([s[i] for s in said], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return rows.mapInArrow(trimmed(run, keeps=True), schema)


def held_out(modulus: int = 4, remainder: int = 2):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder
