"""Text functions: answer normalisation, tokens, numbers, slugs, JSON shapes and labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL_ANSWERS = ["yes", "no", "noanswer"]
NUMBER = r"-?\d+(?:\.\d+)?"
#: Tokens that lexical retrieval keeps whole: paths and versions, letters with digits, acronyms, words, numbers.
PROTECTED = (
    r"(?<![A-Za-z0-9_])([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+|[A-Za-z]+[0-9]+(?:[._/-][A-Za-z0-9]+)*|[vV]?\d+(?:\.\d+)+"
    r"|[A-Z]{2,}(?:-[A-Z0-9]+)*|[A-Za-z]{2,}(?:'[A-Za-z]+)?|\d{2,})(?![A-Za-z0-9_])"
)


def normalise_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def normalise_reward(text: Column) -> Column:
    """Lower case without articles, then letters and digits of any script only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " "), r"(?U)[\W_]+", "")


def _compat(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "")


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFKC; no built-in function composes characters."""
    return text.map(_compat)


@F.pandas_udf(T.StringType())
def normalise_compat(text: pd.Series) -> pd.Series:
    """NFKC without white space, in lower case."""
    return text.map(lambda s: "".join(_compat(s).split()).lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalise_each(texts: pd.Series) -> pd.Series:
    """The same for each member of array<string>; null is empty."""
    return texts.map(lambda row: ["".join(_compat(s).split()).lower() for s in row] if row is not None else [])


def _plain(s: str | None) -> str:
    return "".join(_compat(s).split()).lower()


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def within(texts: pd.Series, parts: pd.Series) -> pd.Series:
    """Of each part, whether it stands in any of the texts (array<string>), as normalise_compat has them; nulls are empty lists."""

    def one(row, wanted) -> list[bool]:
        have = [_plain(t) for t in row] if row is not None else []
        return [any(_plain(p) in t for t in have) for p in wanted] if wanted is not None else []

    return pd.Series([one(a, b) for a, b in zip(texts, parts, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def compose_each(texts: pd.Series) -> pd.Series:
    """NFKC of each member of array<string>, trimmed."""
    return texts.map(lambda row: [_compat(s).strip() for s in row] if row is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_each(texts: pd.Series) -> pd.Series:
    """NFKC with single spaces, case folded, of each member of array<string>."""
    return texts.map(lambda row: [" ".join(_compat(s).split()).casefold() for s in row] if row is not None else None)


@F.pandas_udf(T.StringType())
def fold_title(title: pd.Series) -> pd.Series:
    """NFKC with single spaces, case folded."""
    return title.map(lambda s: " ".join(_compat(s).split()).casefold())


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it inside of loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Non-empty pieces between spaces."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def simple_tokens(text: Column) -> Column:
    """Runs of two or more ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{2,}"), F.lit(0))


def latin_tokens(text: Column) -> Column:
    """Protected tokens of text without CJK letters, lower-cased."""
    return F.transform(F.regexp_extract_all(F.trim(F.coalesce(text, F.lit(""))), F.lit(PROTECTED), F.lit(1)), lambda t: F.lower(t))


def _cjk_pieces(rest: str, cut: Callable[[str], list[str]] | None) -> list[str]:
    import re

    segments = re.findall(r"[㐀-䶿一-鿿]+", rest)
    singles = [w for s in segments for w in (cut(s) if cut else s) if w.strip()]
    pairs = [s if len(s) == 1 else s[i : i + 2] for s in segments for i in range(max(1, len(s) - 1))]
    return singles + list(dict.fromkeys(pairs))


def token_function(cut: Callable[[str], list[str]] | None = None):
    """A column function: protected tokens, then CJK words, then distinct CJK pairs of what is left; NFKC first. cut parts a run of CJK letters into
    words; without one each letter is a word."""
    import re

    pattern = re.compile(PROTECTED)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(text: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[str]:
            s = _compat(s).strip()
            found = [m.group(1).lower() for m in pattern.finditer(s)]
            return found + _cjk_pieces(pattern.sub(lambda m: " " * len(m[0]), s), cut)

        return text.map(one)

    return tokens


retrieval_tokens = token_function()


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def numeric_hit(text: Column, expected: Column) -> Column:
    """Whether any number of the text is within max(1e-6, 0.1 %) of the expected one."""
    bound = F.greatest(F.lit(1e-6), F.abs(expected) * 1e-3)
    return F.coalesce(F.exists(numbers(text), lambda x: F.abs(x - expected) <= bound), F.lit(False))


def exact_match(prediction: Column, gold: Column) -> Column:
    p = normalise_answer(prediction)
    return ((p != "") & F.exists(gold, lambda g: normalise_answer(g) == p)).cast("double")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    each = F.transform(F.array_distinct(a), lambda t: F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def answer_scores(prediction: Column, gold: Column) -> Column:
    """struct<f1, precision, recall> of the gold answer with the best token F1."""

    def special(w: Column) -> Column:
        return (F.size(w) == 1) & F.coalesce(F.try_element_at(w, F.lit(1)).isin(SPECIAL_ANSWERS), F.lit(False))

    def score(p: Column, t: Column, common: Column) -> Column:
        none = (F.size(p) == 0) | (F.size(t) == 0) | ((special(p) | special(t)) & (p != t)) | (common == 0)
        precision, recall = F.try_divide(common, F.size(p)), F.try_divide(common, F.size(t))
        f1 = F.when(none, 0.0).otherwise(F.try_divide(2 * precision * recall, precision + recall))
        return F.struct(f1.alias("f1"), F.when(none, 0.0).otherwise(precision).alias("precision"), F.when(none, 0.0).otherwise(recall).alias("recall"))

    def against(p: Column) -> Column:
        one = lambda t: let(overlap(p, t).cast("double"), lambda n: score(p, t, n))
        return F.transform(gold, lambda g: let(words(normalise_answer(g)), one))

    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return F.aggregate(let(words(normalise_answer(prediction)), against), zero, lambda best, x: F.when(x["f1"] > best["f1"], x).otherwise(best))


def set_scores(predicted: Column, gold: Column) -> Column:
    """struct<precision, recall, f1, em> of two sets; two empty sets agree."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    n = F.size(F.array_intersect(p, g)).cast("double")
    both = (F.size(p) == 0) & (F.size(g) == 0)
    precision = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(n, F.size(p)), F.lit(0.0)))
    recall = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(n, F.size(g)), F.lit(0.0)))
    f1 = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    em = F.when((F.size(p) == F.size(g)) & (n == F.size(p)), 1.0).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), em.alias("em"))


def document_of(evidence: Column) -> Column:
    """What stands before the last # if digits follow it, else all."""
    return F.regexp_replace(evidence, r"#\d+$", "")


def slug(text: Column, size: int = 56) -> Column:
    s = F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), 1, size)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("untitled")).otherwise(s)


def strip_fences(text: Column) -> Column:
    """What stands between a first line of backticks, with whatever it says, and last backticks, if the text starts with them."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```(?:[^\n]*\n)?", ""), r"```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(F.translate(F.coalesce(text, F.lit("")), "\n", " "), 1, size)


def citation(source: Column, chunk: Column, first: Column | None = None, last: Column | None = None, modality: Column | None = None, seconds: Column | None = None) -> Column:
    """`Chunk 3, name, p.1-2`; pictures are `Image 3, name`, film frames `Frame 3, name, t=1.50s`. first, last: pages."""
    none = F.lit(None)
    first, last, seconds = (x if x is not None else none for x in (first, last, seconds))
    base = F.coalesce(source, F.lit("unknown"))
    name = F.when(base.isin("", "unknown"), F.lit("unknown")).otherwise(F.regexp_extract(base, r"([^/]*)$", 1))
    head = F.concat(F.coalesce(chunk.cast("string"), F.lit("NA")), F.lit(", "), name)
    span = F.when(last.isNull() | (last == first), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    text = F.concat(F.lit("Chunk "), head, F.coalesce(F.concat(F.lit(", p."), span), F.lit("")))
    at = F.coalesce(F.concat(F.lit(", t="), F.format_string("%.2f", seconds.cast("double")), F.lit("s")), F.lit(""))
    picture = F.when(seconds.isNotNull(), F.concat(F.lit("Frame "), head, at)).otherwise(F.concat(F.lit("Image "), head))
    return text if modality is None else F.when(modality == "image", picture).otherwise(text)


def bucket10(key: Column) -> Column:
    """0 to 9 by the first eight hex digits of the key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 10).cast("int")


def partition_name(key: Column) -> Column:
    b = bucket10(key)
    return F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")


# Fixed values.
ACTION_FIELDS = ["tool", "args", "final_answer"]


def kind_of(value: Column, path: str) -> Column:
    """The type of what a variant has at a path, as schema_of_variant names it; null where it has nothing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def action_error(raw: Column) -> Column:
    """Why a text is no strict JSON action, null if it is one.

    An action has no other fields than tool, args and final_answer, and either a named tool or a final_answer that is true, not both;
    args, if there are any, are an object, and none come with a final answer.
    """
    v = F.try_parse_json(raw)
    unknown = F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, ACTION_FIELDS))))
    final = F.coalesce((kind_of(v, "$.final_answer") == "BOOLEAN") & F.try_variant_get(v, "$.final_answer", "boolean"), F.lit(False))
    tool = F.coalesce((kind_of(v, "$.tool") == "STRING") & (F.trim(F.try_variant_get(v, "$.tool", "string")) != ""), F.lit(False))
    args = kind_of(v, "$.args")
    some = F.coalesce(F.size(F.json_object_keys(F.get_json_object(raw, "$.args"))) > 0, F.lit(False))
    return (
        F.when(v.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "action must be a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown action fields: "), F.array_join(unknown, ", ")))
        .when(final == tool, "action must choose exactly one tool call or final_answer")
        .when(~args.startswith("OBJECT"), "action args must be a JSON object")
        .when(final & some, "final_answer does not accept args")
    )


def action_kind(raw: Column) -> Column:
    """`tool`, `final` or `invalid` of a strict JSON action."""
    tool = F.trim(F.coalesce(F.get_json_object(raw, "$.tool"), F.lit("")))
    return F.when(action_error(raw).isNotNull(), "invalid").when(tool != "", "tool").otherwise("final")
