"""BPE encoding and decoding by speculation: greedy longest match proposes a word's tokens, a vectorised
test of every adjacent pair accepts them, and only the words that fail are merged exactly.

A sequence of tokens is what BPE makes of a word if each token is what BPE makes of its own symbols and
each adjacent pair is what BPE makes of the pair's symbols. Both facts depend on the vocabulary alone, so
they are worked out once for each token or pair that occurs and looked up from then on.

Nulls and empty texts have no tokens. Very long texts are encoded whole, and a very long word is merged with a heap. Repeated
rows stay; an empty table gives an empty result. Other columns pass through `encode` unread.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, mix, small_batches, trimmed

#: White space of the vocabulary's splitting pattern, as a character class. Fixed values.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words whose tokens a worker remembers; slots of its table of tested pairs.
WORDS_KEPT = 500_000
PAIR_SLOTS = 1 << 20
#: Symbols up to which merging rescans a list; a rank above all.
SHORT = 40
NEVER = 1 << 60
#: Beyond this letter the library's own normaliser and splitter are asked, since tables of letters differ between versions of Unicode.
FAMILIAR = "\u024f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def familiar(kind: str) -> str:
    """The members of a general category up to FAMILIAR, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(ord(FAMILIAR) + 1)) if unicodedata.category(c)[0] == kind)


class WordBpe:
    """The encoder of one vocabulary file (content as text) whose words end in a suffix."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        kinds = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or spec["decoder"] or model["byte_fallback"]:
            raise ValueError("this encoder reads word-ended byte-level BPE files only")
        library = Tokenizer.from_str(content)
        self.lib_normalizer, self.lib_splitter = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.added).items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, members in (("\\p{L}", familiar("L")), ("\\p{N}", familiar("N")), ("\\s", WHITE)):
            pattern = pattern.replace(name, members)
        self.split = re.compile(pattern).findall
        self.letters = byte_letters()
        self.longest = max(len(t) - len(self.suffix) * t.endswith(self.suffix) for t in self.vocab)
        self.alone: dict[int, bool] = {}
        self.pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_good = np.zeros(PAIR_SLOTS, bool)
        self.words: dict[str, tuple[bytes, str]] = {}
        self.merged = self.proposed = 0

    # -- exact merging ------------------------------------------------------------------------------

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE itself: the best-ranked adjacent pair is joined, leftmost first, until none is left."""
        if len(symbols) > SHORT:
            return self.merge_long(symbols)
        rank, out = self.rank, list(symbols)
        scores = [rank.get(p, NEVER) for p in zip(out, out[1:])]
        while scores and (best := min(scores)) < NEVER:
            i = scores.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank.get((out[i - 1], out[i]), NEVER)
            if i < len(scores):
                scores[i] = rank.get((out[i], out[i + 1]), NEVER)
        return out

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, whose time does not grow with the square of the length."""
        n = len(symbols)
        text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.rank.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or text[i] != a or text[j] != b:
                continue
            text[i], live[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self.rank.get((text[x], text[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, text[x], text[after[x]]))
        return [t for t, on in zip(text, live, strict=True) if on]

    def symbols(self, token: str) -> list[str]:
        """The single letters from which a token or a run of tokens is merged; a suffix belongs to the last letter."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    # -- speculation and test -----------------------------------------------------------------------

    def propose(self, word: str) -> list[int]:
        """Longest tokens first, from left to right; -1 where no token fits."""
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                token = self.vocab.get(word[i:j] + self.suffix if j == n else word[i:j])
                if token is not None:
                    break
            else:
                token, j = -1, n
            out.append(token)
            i = j
        return out

    def fits_alone(self, token: int) -> bool:
        if (good := self.alone.get(token)) is None:
            good = self.alone[token] = token >= 0 and self.merge(self.symbols(self.names[token])) == [self.names[token]]
        return good

    def fit_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * 2**32 + right) is what BPE makes of its symbols."""
        uniq, back = np.unique(keys, return_inverse=True)
        slot = (mix(uniq.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        known, good = self.pair_keys[slot] == uniq, self.pair_good[slot]
        for x in np.flatnonzero(~known):
            a, b = self.names[int(uniq[x] >> 32)], self.names[int(uniq[x] & 0xFFFFFFFF)]
            good[x] = self.merge(list(a) + self.symbols(b)) == [a, b]
        self.pair_keys[slot], self.pair_good[slot] = uniq, good
        return good[back]

    def learn(self, words: set[str]) -> None:
        """Puts the tokens of words into the cache."""
        words = list(words)
        spelled = ["".join(map(self.letters.__getitem__, w.encode())) for w in words]
        guess = [self.propose(s) for s in spelled]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(words)), size)
        bad = np.zeros(len(words), bool)
        uniq, back = np.unique(flat, return_inverse=True)
        bad[of[~np.fromiter(map(self.fits_alone, map(int, uniq)), bool, len(uniq))[back]]] = True
        inner = np.flatnonzero((of[1:] == of[:-1]) & ~bad[of[1:]]) if len(of) else np.empty(0, np.int64)
        if len(inner):
            fit = self.fit_pairs((flat[inner] << 32) | flat[inner + 1])
            bad[of[inner[~fit]]] = True
        self.proposed += len(words)
        self.merged += int(bad.sum())
        for i, w in enumerate(words):
            ids = [self.vocab[t] for t in self.merge(self.symbols(spelled[i] + self.suffix))] if bad[i] else guess[i]
            self.words[w] = (np.array(ids, np.int32).tobytes(), " ".join(map(self.names.__getitem__, ids)))

    # -- texts --------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str | int]:
        """Words, and ids of added tokens that stand in the raw text."""
        out: list[str | int] = []
        for part in self.special.split(text) if any(a in text for a in self.added) else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if part.isascii() or max(part) <= FAMILIAR:  # no combining marks: composed as it is
                    out += self.split(part.lower())
                else:
                    clean = self.lib_normalizer.normalize_str(part)
                    out += [clean[a:b] for _, (a, b) in self.lib_splitter.pre_tokenize_str(clean)]
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Packed ids and decoded text of each text."""
        ids, said = [], []
        split = [self.pieces(t) if t else [] for t in texts]
        asked = set().union(*split)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        unseen = asked.difference(self.words)
        self.learn({w for w in unseen if isinstance(w, str)})
        for i in unseen:
            if isinstance(i, int):
                self.words[i] = (np.array([i], np.int32).tobytes(), self.names[i])
        for row in split:
            got = list(map(self.words.__getitem__, row))
            ids.append(b"".join([g[0] for g in got]))
            said.append(" ".join([g[1] for g in got]))
        return ids, said


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the token ids of column `text` (array<int>) and the text that they decode to.

    The vocabulary is read where the plan is made and sent along: its size is that of the file. A name that
    df has already is replaced. Null texts give no ids and an empty decoded text.
    """
    small_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    key, sent = hashlib.sha256(content.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(content)
    rows = df.drop(ids, decoded)
    schema = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    at = rows.columns.index(text)

    def run(batches):
        bpe = kept(key, lambda: WordBpe(sent.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                packed, said = bpe.encode(part.column(at).to_pylist())
                ends = np.cumsum([0, *map(len, packed)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(said, pa.string())], names=schema.names)

    return rows.mapInArrow(trimmed(run, keeps=True), schema)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that the ids decode to: the tokens' names joined by spaces, as a file without a decoder has it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    names = [""] * size
    for t, i in [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
        names[i] = t
    sent = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf(T.StringType())
    def say(column):
        return column.map(lambda row: " ".join(map(sent.value.__getitem__, row)) if row is not None else "")

    return df.withColumn(decoded, say(F.col(ids)))


def digests(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens and the digests of ids and of the decoded text."""
    return df.select(
        "doc_id",
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
