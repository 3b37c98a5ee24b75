"""Chunks of texts: fixed strides, sentences, paragraphs, soft boundaries and semantic groups."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.arrays import grown, members, none_yet

CHUNK = "chunk_id int, source string, text string, start int, end int, token_start int, token_end int, boundary string, chunk_strategy string"
#: White space follows, or the text ends.
SENTENCE_END = r"(?:[.!?]|[。！？])(?:\s|\n|$)"
PARAGRAPH_END = r"\n{2,}"


def fixed_stride(df: DataFrame, tokens: Column, size: int = 700, overlap: int = 120) -> DataFrame:
    """df's rows with chunk_id, token_start, token_end and text of each window of `size` tokens, the last one kept as it is."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size")
    rows = df.withColumn("_t", tokens).filter(F.size("_t") > 0)
    step = size - overlap
    # windows up to the first that reaches the end
    last = F.greatest(F.lit(0), F.ceil((F.size("_t") - size) / step)).cast("int")
    rows = rows.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_id") * step
    stop = F.least(start + size, F.size("_t"))
    return rows.withColumns({"token_start": start, "token_end": stop, "chunk_text": F.array_join(F.slice("_t", start + 1, F.lit(size)), " ")}).drop("_t")


def pieces(df: DataFrame, text: str, end: str, keep: str) -> DataFrame:
    """df's rows with ord, start, stop and piece of each trimmed, non-empty stretch of the text up to an end pattern.

    keep: what of the end pattern belongs to the stretch, as a replacement; offsets are code points.
    """
    mark = "\ue000"
    cut = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({end})", keep + mark), mark)
    first = F.struct(F.lit(0).alias("at"), *none_yet("struct<at:int,raw:string>"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), *grown(s, F.struct(s["at"].alias("at"), x.alias("raw")), F.lit(True)))
    placed = F.aggregate(cut, first, step, members)
    rows = df.select("*", F.posexplode(placed).alias("ord", "_p")).select("*", F.col("_p")["at"].alias("_at"), F.col("_p")["raw"].alias("_raw")).drop("_p")
    left = F.length("_raw") - F.length(F.regexp_replace("_raw", r"^\s+", ""))
    trimmed = F.regexp_replace(F.regexp_replace("_raw", r"^\s+", ""), r"\s+$", "")
    out = rows.withColumns({"piece": trimmed, "start": F.col("_at") + left}).withColumn("stop", F.col("start") + F.length("piece"))
    return out.filter("piece <> ''").drop("_raw", "_at")


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return pieces(df, text, SENTENCE_END, "$1")


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    return pieces(df, text, PARAGRAPH_END, "$1")


def neighbour_similarity(df: DataFrame, by: str, order: str, vector: str) -> DataFrame:
    """df with `similarity` to the row before it."""
    from tidemill.functions.vector import safe_cosine

    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_before", F.lag(vector).over(w)).withColumn("similarity", F.when(F.col("_before").isNotNull(), safe_cosine(F.col("_before"), F.col(vector)))).drop("_before")


# -- sequential strategies: each cut depends on the last ------------------------------------------------

_SENTENCE = re.compile(SENTENCE_END)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Exact offsets of tokens where no model's vocabulary is at hand: a word with the white space before it."""
    return [m.span() for m in re.finditer(r"\s*\S+", text)]


def vocabulary_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """Offsets of a tokenizer file's tokens, for chunk_text: exact ones, so that no character is split or lost. The file is read once a worker."""

    def spans(text: str) -> list[tuple[int, int]]:
        if path not in _VOCABULARIES:
            from tokenizers import Tokenizer

            _VOCABULARIES[path] = Tokenizer.from_file(path)
            _VOCABULARIES[path].no_truncation()
            _VOCABULARIES[path].no_padding()
        out, at = [], 0
        for a, b in _VOCABULARIES[path].encode(text, add_special_tokens=False).offsets:
            if b > at:  # tokens within one character have its span together
                out.append((max(a, at), b))
                at = b
        return out

    return spans


_VOCABULARIES: dict = {}


def _soft_cut(text: str, start: int, hard: int) -> tuple[int, str]:
    least = start + int((hard - start) * 0.6)
    if least >= hard:
        return hard, "hard"
    at = text.rfind("\n\n", least, hard)
    if at >= 0:
        return at + 2, "paragraph"
    ends = [start + m.end() for m in _SENTENCE.finditer(text[start:hard])]
    if ends and ends[-1] >= least:
        return ends[-1], "sentence"
    at = text.rfind("\n", least, hard)
    return (at + 1, "line") if at >= 0 else (hard, "hard")


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    piece = text[a:b]
    lead = len(piece) - len(piece.lstrip())
    return (a + lead, a + lead + len(piece.strip())) if piece.strip() else (a, a)


def token_chunks(text: str, size: int, overlap: int, spans: list[tuple[int, int]]) -> Iterator[tuple]:
    """(chunk_id, start, end, token_start, token_end, boundary): windows of tokens, cut at a soft boundary after 60 %."""
    total, first, number = len(spans), 0, 0
    while first < total:
        last, why = min(first + size, total), "hard"
        if last < total:
            cut, why = _soft_cut(text, spans[first][0], spans[last - 1][1])
            n = first
            while n < last and spans[n][1] <= cut:
                n += 1
            last = n if n > first else last
        a, b = _trim(text, spans[first][0], spans[last - 1][1])
        if b > a:
            yield number, a, b, first, last, why
            number += 1
        if last >= total:
            return
        first = max(last - overlap, first + 1)


def _units(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for p in [*re.finditer(PARAGRAPH_END, text), None]:
        stop = p.start() if p else len(text)
        inner = at
        for m in [*_SENTENCE.finditer(text[at:stop]), None]:
            b = at + m.end() if m else stop
            a, b2 = _trim(text, inner, b)
            if b2 > a:
                out.append((a, b2))
            inner = b
        at = p.end() if p else stop
    return out


def semantic_chunks(text: str, size: int, overlap: int, spans: list[tuple[int, int]], embed: Callable | None, threshold: float, least: int) -> Iterator[tuple]:
    """Neighbouring sentences together until the tokens run out or the likeness of two neighbours falls; else token_chunks."""
    units = _units(text)
    vectors = embed([text[a:b] for a, b in units]) if embed and len(units) > 1 else []
    if len(units) <= 1 or len(vectors) != len(units):
        yield from token_chunks(text, size, overlap, spans)
        return
    starts, ends = [x for x, _ in spans], [y for _, y in spans]
    tokens = []
    for a, b in units:  # spans are in order, so those that touch a unit stand together
        first, last = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        tokens.append((first, last) if first < last else (0, 1))

    def like(u, v) -> float:
        nu, nv = math.sqrt(sum(x * x for x in u)), math.sqrt(sum(x * x for x in v))
        return sum(x * y for x, y in zip(u, v, strict=True)) / (nu * nv) if nu > 1e-12 and nv > 1e-12 else 0.0

    number, first, used = 0, 0, max(1, tokens[0][1] - tokens[0][0])
    for i in range(1, len(units) + 1):
        more = max(1, tokens[i][1] - tokens[i][0]) if i < len(units) else 0
        full = i < len(units) and used + more > size
        apart = i < len(units) and i - first >= least and like(vectors[i - 1], vectors[i]) < threshold
        if i == len(units) or full or apart:
            yield number, units[first][0], units[i - 1][1], tokens[first][0], tokens[i - 1][1], "token_limit" if full else "semantic"
            number, first, used = number + 1, i, more
        else:
            used += more


def chunk_text(df: DataFrame, text: str = "text", source: str = "source", size: int = 700, overlap: int = 120, strategy: str = "token", threshold: float = 0.78, least: int = 2, embed: Callable | None = None, spans: Callable = word_spans) -> DataFrame:
    """Chunks of each text (stripped; blank texts have none), in the schema CHUNK. A vocabulary comes in as `spans`, a model as `embed`."""
    if size <= 0 or not 0 <= overlap < size or not 0 <= threshold <= 1 or least <= 0 or strategy not in ("token", "semantic"):
        raise ValueError("chunking parameters")

    def run(frames):
        for frame in frames:
            rows = []
            for t, s in zip(frame["text"], frame["source"], strict=True):
                clean = (t or "").strip()
                if clean:
                    at = spans(clean)
                    found = token_chunks(clean, size, overlap, at) if strategy == "token" else semantic_chunks(clean, size, overlap, at, embed, threshold, least)
                    rows += [(i, s, clean[a:b].strip(), a, b, ta, tb, why, strategy) for i, a, b, ta, tb, why in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return df.select(F.col(text).alias("text"), F.col(source).cast("string").alias("source")).mapInPandas(run, CHUNK)
