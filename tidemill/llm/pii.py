"""PII extraction by bootstrapping: seed entities induce lexical patterns, a pattern-instance graph is scored
iteratively, and patterns of high confidence discover identifiers that the seeds' forms miss. DataFrame
functions only.

Seeds are the base matches: emails, IPv4 addresses, card numbers and phone numbers, leftmost and without
overlap for each kind; a match that fails its kind's test is dropped and not tried again at another place.
Positions are found by putting a private character around each match and adding up the lengths of the pieces
between. The regular expressions have no repeated groups, so that a very long run costs linear time and no stack; each
finds just what its contract's form finds.

Base spans are seeds, those that overlap one of them together, and so are tokens of a form that only secrets have (SECRET).
Identifier tokens are runs of TOKEN letters with a digit or an at sign that touch no base span. The pattern of either is the two words before it, lower-cased, digits as 0, earlier spans and
tokens as their kind in brackets, the start of a text as words of its own; its instance is its text, lower-cased.
A pattern's confidence is the sum of its instances' scores over their number plus PRIOR; an instance's score is
1 for seeds, else one minus the product of (1 - confidence) over its patterns. After ROUNDS rounds, tokens whose
pattern has SUPPORT distinct seed instances and confidence CONFIDENT become spans of kind `context`, secrets among them; a
secret's form alone makes no span.

Base spans are never dropped. Null and empty texts have no spans, an empty table gives an empty result. Rows that repeat a doc_id are told apart by a
hash of their text; equal rows come back as often as they occur. A character U+E000 to U+E005 in a text counts as one that no
form has. Columns of docs are read only by the names given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.arrays import grown, members, none_yet
from tidemill.functions.text import let

from .common import settle

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = "context"
MARK, DOT = "\ue000", "\ue001"
#: What stands for a span of each kind while tokens are sought.
PLACES = "\ue002\ue003\ue004\ue005"
START = "^ ^ "
BLOCK = 64
ROUNDS = 3
PRIOR = 1.0
SUPPORT = 3
CONFIDENT = 0.6

LOCAL = r"A-Za-z0-9._%+\-" + DOT
LABEL = r"A-Za-z0-9\-"
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: For each kind: what a text must have at all, what is marked, and how.
FORMS = {
    "email": ("@", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[{LABEL}]++\.[{LABEL}][{LABEL}.]*+", f"{MARK}$0{MARK}"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"{MARK}$0{MARK}"),
    "card": (r"(?:[0-9][ \-]?){12}[0-9]", r"(?<![0-9])(?<![0-9][ \-])(?=[0-9])|(?<=[0-9])(?![ \-]?[0-9])", MARK),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9\-]+[0-9]", f"{MARK}$0{MARK}"),
}
TOKEN = r"A-Za-z0-9._@%+/=\-"
#: Tokens that only secrets look like: long hexadecimal digests and keys with a known beginning. Fixed values.
SECRET = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})$"
TOKENS = rf"(?<![{TOKEN}{PLACES}])(?=[A-Za-z._%+/=\-]*+[0-9@])[{TOKEN}]{{6,}}+(?![{PLACES}])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the card checksum."""
    n = F.length(digits)

    def doubled(i: Column) -> Column:
        c = F.ascii(F.substring(digits, n + 1 - i, F.lit(1))) - 48
        return F.when(i % 2 == 1, c).otherwise((c * 2) % 10 + F.when(c > 4, 1).otherwise(0))

    each = F.transform(F.sequence(F.lit(1), n), doubled)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike("^" + r"\.".join([OCTET] * 4) + "$"),
        "card": F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
    }[kind]


def _places(pieces: Column, kind: str) -> Column:
    """(start, end, piece) of every second piece of marked text that passes its kind's test."""
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), *none_yet("struct<start:int,stop:int>"))

    def step(acc: Column, piece: Column) -> Column:
        plain = F.replace(piece, F.lit(DOT)) if kind == "email" else piece
        stop = acc["at"] + F.length(plain)
        hit = (acc["i"] % 2 == 1) & passes(kind, plain)
        return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), *grown(acc, F.struct(acc["at"].alias("start"), stop.alias("stop")), hit))

    return F.aggregate(pieces, first, step, members)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, stop>> of a kind's matches, in code points."""
    needs, form, marked = FORMS[kind]
    source = F.regexp_replace(text, rf"\.(?![{LABEL}])", DOT + ".") if kind == "email" else text
    found = _places(F.split(F.regexp_replace(source, form, marked), MARK), kind)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def _merged(spans: dict[str, Column]) -> Column:
    """array<struct<start, stop, kind>> of all kinds' spans in order; overlapping ones become one, named by the first."""
    named = lambda k: lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(k).alias("kind"))
    every = [F.transform(c, named(k)) for k, c in spans.items()]
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(None).cast("string").alias("kind"))
    first = F.struct(none.alias("last"), *none_yet("struct<start:int,stop:int,kind:string>"))

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        apart = s["start"] >= last["stop"]
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        return F.struct(F.when(apart, s).otherwise(longer).alias("last"), *grown(acc, last, apart & last["kind"].isNotNull()))

    def closed(acc: Column) -> Column:
        done = members(acc)
        return F.when(acc["last"]["kind"].isNull(), done).otherwise(F.array_append(done, acc["last"]))

    return F.aggregate(F.array_sort(F.concat(*every)), first, step, closed)


def _replaced(text: Column, merged: Column, place: Callable[[Column], Column]) -> Column:
    """The text with place(span) for each span. A cut by offset reads a text from its start, so BLOCK spans' stretch is cut out first."""

    def joined(mine: Column, begin: Column) -> Column:
        stretch = F.substring(text, begin + 1, F.element_at(mine, -1)["stop"] - begin)

        def within(body: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(mine, i - 1)["stop"]).otherwise(begin)
            return F.array_join(F.transform(mine, lambda s, i: F.concat(F.substring(body, before(i) - begin + 1, s["start"] - before(i)), place(s))), "")

        return let(stretch, within)

    begin = lambda b: F.when(b > 0, F.get(merged, b * BLOCK - 1)["stop"]).otherwise(0)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(merged) - 1) / BLOCK).cast("int")), lambda b: let(F.slice(merged, b * BLOCK + 1, F.lit(BLOCK)), lambda mine: joined(mine, begin(b))))
    end = F.element_at(merged, -1)["stop"]
    return F.when(F.size(merged) > 0, F.concat(F.array_join(blocks, ""), F.substring(text, end + 1, F.length(text)))).otherwise(text)


def _masked(text: Column, merged: Column) -> Column:
    """The text with one private character in place of each span."""
    places = F.create_map(*[F.lit(x) for pair in zip(KINDS, PLACES, strict=True) for x in pair])
    return _replaced(text, merged, lambda s: F.element_at(places, s["kind"]))


def _tokens(text: Column, merged: Column, masked: Column) -> Column:
    """array<struct<start, stop, pattern, instance, base, seed>> of a text's base spans and identifier tokens."""
    kind = "struct<start:int,stop:int,pattern:string,instance:string,base:boolean,seed:boolean>"
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("spans"), F.lit(START).alias("before"), *none_yet(kind))
    pieces = F.split(F.regexp_replace(masked, rf"{TOKENS}|[{PLACES}]", f"{MARK}$0{MARK}"), MARK)

    def step(acc: Column, piece: Column) -> Column:
        unit = acc["i"] % 2 == 1
        base = unit & piece.isin(*PLACES)
        span = F.get(merged, acc["spans"])
        stop = F.when(base, span["stop"]).otherwise(acc["at"] + F.length(piece))
        left = F.regexp_replace(F.lower(acc["before"]), "[0-9]", "0")
        pattern = F.regexp_extract(left, r"([^\s]{1,30}\s+[^\s]{1,30})\s*$", 1)
        instance = F.when(base, F.substring(text, span["start"] + 1, span["stop"] - span["start"])).otherwise(piece)
        entry = F.struct(acc["at"].alias("start"), stop.alias("stop"), F.regexp_replace(pattern, r"\s+", " ").alias("pattern"), F.lower(instance).alias("instance"), base.alias("base"), (base | piece.rlike(SECRET)).alias("seed"))
        said = F.when(base, F.concat(F.lit("["), span["kind"], F.lit("]"))).when(unit, f"[{CONTEXT}]").otherwise(F.right(piece, F.lit(70)))
        before = F.right(F.concat(acc["before"], said), F.lit(70))
        return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), (acc["spans"] + base.cast("int")).alias("spans"), before.alias("before"), *grown(acc, entry, unit & (pattern != "")))

    return F.when((F.size(merged) > 0) | text.rlike(TOKENS), F.aggregate(pieces, first, step, members)).otherwise(F.array().cast(f"array<{kind}>"))


def patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confidence and support (seed instances) of each pattern of the graph. edges: pattern, instance, seed; distinct."""
    support = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("support"))
    # a pattern without seeds can only score through instances that a seeded pattern shares
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        confidence = settle(edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence")))
        one_minus = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        scores = edges.join(confidence, "pattern").groupBy("instance").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - F.exp(F.sum(one_minus))).alias("score"))
    return confidence.join(support, "pattern")


def find(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, row (tells apart rows of one id) and, for each kind and for context, array<struct<start, stop>> of each row of docs."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK + DOT + PLACES, "\x01" * 6)
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), clean.alias("clean"))
    rows = rows.select("*", *[base_spans(F.col("clean"), k).alias(k) for k in KINDS])
    rows = rows.withColumn("merged", _merged({k: F.col(k) for k in KINDS}))
    rows = rows.withColumn("masked", _masked(F.col("clean"), F.col("merged")))
    rows = settle(rows.select("doc_id", "row", *KINDS, _tokens(F.col("clean"), F.col("merged"), F.col("masked")).alias("tokens")))
    tokens = rows.filter(F.size("tokens") > 0).select("doc_id", "row", F.explode("tokens").alias("t")).select("doc_id", "row", "t.*")
    edges = settle(tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    good = patterns(edges, rounds).filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern")
    fresh = tokens.filter("NOT base").join(good, "pattern", "left_semi").select("doc_id", "row", F.struct("start", "stop").alias("s")).distinct()
    # a row's own tokens, no more than it has words
    fresh = fresh.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("s")).alias(CONTEXT)).withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row")
    both = rows.join(fresh, rows["doc_id"].eqNullSafe(fresh["_id"]) & (rows["row"] == fresh["_row"]), "left")
    return both.select("doc_id", "row", *KINDS, F.coalesce(CONTEXT, F.array().cast("array<struct<start:int,stop:int>>")).alias(CONTEXT))


def _said(kinds: list[str]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_said(KINDS), 256).alias("base_sha256"),
        _said([*KINDS, CONTEXT]).alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Texts meet their spans by id in one join; only rows with spans take part.
    """
    spans = found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), _merged({k: F.col(k) for k in [*KINDS, CONTEXT]}).alias("_spans"))
    spans = spans.filter(F.size("_spans") > 0).dropDuplicates(["_id", "_row"])
    source = docs[text]
    clean = _replaced(source, spans["_spans"], lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(docs[text]) == spans["_row"]), "left")
    return joined.select(*[(F.when(spans["_spans"].isNull(), source).otherwise(clean).alias(c) if c == text else docs[c]) for c in docs.columns])
