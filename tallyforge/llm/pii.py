"""Personal data: fixed base detectors, and bootstrapped contextual extraction on top.

DataFrame functions only. One scan of the texts yields a small table: the base spans
of each document, and its other identifier-like tokens, each with the word before and
after. Those are words with a digit, an at sign (also spelled) or a separator between
letters, and runs of several words: groups of digits, and addresses with spelled signs.
Everything else works on that table.

Bootstrapping: base spans are seed instances. A lexical pattern is a neighbouring
word on one side. Patterns and distinct instances form a bipartite graph; in each of
``ROUNDS`` rounds a pattern's confidence in a kind is the share of its instances'
scores for that kind, where instances of other kinds count in full, those not known to
be of any kind as ``UNKNOWN`` each, and one more is added to the denominator. An
instance's score is the noisy-or of its trusted patterns; found instances are known in
the next round. Tokens that end with a score of ``TRUST`` or more join the document's
spans under that kind, unless they lie in a longer one.

Null text counts as empty. Rows with equal doc_id and text get the same spans. Spans
are in code points, end exclusive. Context words are whole, however long, as are texts.
An instance that patterns name under two kinds alike goes to the later kind of ``KINDS``.
An empty table gives no rows; columns beside doc_id and text are not read (``redact``
hands them on, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns. Possessive quantifiers and the look-behind keep them linear
#: on long runs and change no match: a run that fails at its start fails everywhere.
#: A card pattern's minimum of 13 digits only skips runs that the filter would drop.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)\S*?(?:[0-9@]|[(\[{](?i:at)[)\]}]|\p{L}[._+:/-]\p{L})\S*+"
_NAME, _AT, _DOT = r"[A-Za-z0-9._%+-]++", r"(?i:at)", r"\s[(\[{]?(?i:dot)[)\]}]?\s"
RUN = (
    r"(?<!\S)(?:[+(]?[0-9][0-9().:/-]*+(?:[\x20\t][+(]?[0-9][0-9().:/-]*+(?!\S))++"
    rf"|{_NAME}\s(?:[(\[{{]{_AT}[)\]}}]\s[A-Za-z0-9.-]++(?:{_DOT}[A-Za-z0-9-]++)*+|{_AT}\s[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++))"
)
#: Code points in which a neighbouring word is looked for before the whole text is.
WINDOWS = (64, 4096)
ROUNDS = 3
TRUST = 0.9
SUPPORT = 5
UNKNOWN = 0.05


def _located(text: Column, pattern: str) -> Column:
    """array<struct<m, s, e>>: matches with their places; the pieces between give the places."""
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")

    def places(x: Column) -> Column:
        def add(state: Column, m: Column) -> Column:
            end = state["at"] + F.length(m)
            nxt = F.coalesce(F.length(F.try_element_at(x["pieces"], state["k"])), F.lit(0))
            return F.struct((end + nxt).alias("at"), F.concat(state["out"], F.array(F.struct(m.alias("m"), state["at"].alias("s"), end.alias("e")))).alias("out"), (state["k"] + 1).alias("k"))

        return F.aggregate(x["matches"], F.struct(F.length(F.element_at(x["pieces"], 1)).alias("at"), empty.alias("out"), F.lit(2).alias("k")), add)["out"]

    # Bound to a lambda's variable, the text is cut once and not once for each match.
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    found = F.element_at(F.transform(F.array(both), places), 1)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<m:string,s:int,e:int>>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\.", -1), part)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["m"])


def _tagged(i: int):
    return lambda x: F.struct(F.lit(i).cast("int").alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def _word_before(text: Column, at: Column) -> Column:
    """The whole word that ends before a place; a window that may cut it is widened, at last to all."""
    word = lambda piece: F.regexp_extract(piece, r"(?<!\S)(\S++)\s*+$", 1)
    out = word(F.substring(text, F.lit(1), at))
    for n in reversed(WINDOWS):
        piece = F.substring(text, F.greatest(at - (n - 1), F.lit(1)), F.least(at, F.lit(n)))
        out = F.when((at <= n) | ~piece.rlike(r"^\S*+\s*+$"), word(piece)).otherwise(out)
    return out


def _word_after(text: Column, at: Column) -> Column:
    """The whole word that starts after a place, likewise."""
    word = lambda piece: F.regexp_extract(piece, r"^\s*+(\S++)", 1)
    out = word(F.substring(text, at + 1, F.length(text)))
    for n in reversed(WINDOWS):
        piece = F.substring(text, at + 1, F.lit(n))
        out = F.when((F.length(piece) < n) | ~piece.rlike(r"^\s*+\S*+$"), word(piece)).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), a base span array per kind and ``others``."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    for kind in KINDS:
        out = out.withColumn(f"raw_{kind}", _located(text, PATTERNS[kind]))
    for kind in KINDS:
        out = out.withColumn(kind, F.filter(f"raw_{kind}", _check(kind)))
    every = F.flatten(F.array(*[F.col(k) for k in KINDS]))
    out = out.withColumn("one", _located(text, TOKEN)).withColumn("run", _located(text, RUN)).withColumn("tokens", F.array_distinct(F.concat("one", "run"))).withColumn("_base", every)
    out = out.withColumn("others", F.filter("tokens", lambda t: ~F.exists("_base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))))

    def context(kind: Column):
        return lambda x: _context(x, kind)

    def _context(x: Column, kind: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), F.lower(_word_before(text, x["s"])).alias("left"), F.lower(_word_after(text, x["e"])).alias("right"))

    seen = F.concat(*[F.transform(k, context(F.lit(k))) for k in KINDS], F.transform("others", context(F.lit(None).cast("string"))))
    spans = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    return out.select("doc_id", F.xxhash64("text").alias("h"), *spans, seen.alias("seen"))


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """inst, kind, score: tokens outside the base that trusted patterns name."""
    one = scanned.where(F.size("seen") > 0).select(F.explode("seen").alias("x")).select(F.col("x.m").alias("inst"), F.col("x.kind").alias("kind"), F.explode(F.array(F.concat(F.lit("L "), F.col("x.left")), F.concat(F.lit("R "), F.col("x.right")))).alias("ctx"))
    edges = shared_checkpoint(one.where(F.length("ctx") > 2).groupBy("inst", "ctx").agg(F.max("kind").alias("kind")))
    ways = F.array(*[F.lit(k) for k in KINDS])
    seeds = edges.where("kind IS NOT NULL").select("ctx", "kind", F.lit(1.0).alias("score"))
    total = edges.groupBy("ctx").agg(F.count(F.lit(1)).alias("total"), F.max("kind").alias("any")).where(F.col("any").isNotNull() & (F.col("total") >= support)).drop("any")
    loose, found = edges.where("kind IS NULL").select("inst", "ctx"), None
    for _ in range(rounds):
        scored = seeds if found is None else seeds.unionByName(loose.join(found, "inst").select("ctx", "kind", "score"))
        sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS]
        rated = scored.groupBy("ctx").agg(*sums, F.count(F.lit(1)).alias("known")).join(total, "ctx")
        every = sum([F.col(k) for k in KINDS], UNKNOWN * (F.col("total") - F.col("known")) + 1)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("mass"), (F.col(k) / every).alias("conf")) for k in KINDS]))
        patterns = rated.select("ctx", each.alias("x")).select("ctx", "x.*").where((F.col("conf") >= trust) & (F.col("mass") >= support))
        miss = F.sum(F.log(1 - F.col("conf")))
        found = loose.join(patterns, "ctx").groupBy("inst", "kind").agg((1 - F.exp(miss)).alias("score")).where(F.col("score") >= trust)
        best = F.max_by("kind", F.struct("score", F.array_position(ways, F.col("kind")))).alias("kind")
        found = found.groupBy("inst").agg(best, F.max("score").alias("score"))
    return found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h, a base array per kind, and ``spans``: array<struct<k, s, e>> in order."""
    scanned = shared_checkpoint(scan(docs))
    found = shared_checkpoint(bootstrap(scanned))
    extra = scanned.select("doc_id", "h", F.explode("seen").alias("x")).where("x.kind IS NULL").select("doc_id", "h", F.col("x.m").alias("inst"), "x.s", "x.e").join(found, "inst")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    extra = extra.groupBy("doc_id", "h").agg(F.collect_set(F.struct(rank.alias("k"), "s", "e")).alias("extra"))
    longer = lambda x: lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
    extra = extra.withColumn("extra", F.filter("extra", lambda x: ~F.exists("extra", longer(x))))
    right = extra.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "extra")
    joined = scanned.join(right, scanned["doc_id"].eqNullSafe(right["_d"]) & (scanned["h"] == right["_h"]), "left")
    base = F.concat(*[F.transform(k, _tagged(i)) for i, k in enumerate(KINDS, 1)])
    spans = F.array_sort(F.concat(base, F.coalesce("extra", F.array().cast("array<struct<k:int,s:int,e:int>>"))))
    return joined.select("doc_id", "h", *KINDS, base.alias("base"), spans.alias("spans"))


def _joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; spans in ``text`` become ``[kind]``. Null text stays null."""
    found = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__pii_d"), F.col("h").alias("__pii_h"), F.col("spans").alias("__pii_spans")).dropDuplicates(["__pii_d", "__pii_h"])
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__pii_d"]) & (F.xxhash64(text) == found["__pii_h"]), "left")
    name = F.array(*[F.lit(k) for k in KINDS])
    byplace = F.array_sort(F.transform("__pii_spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))

    def step(state: Column, x: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit("["), F.element_at(name, x["k"]), F.lit("]"))
        return F.when(x["s"] >= state["at"], F.struct((-x["e"]).alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(state["at"], -x["e"]).alias("at"), state["out"].alias("out")))

    done = F.aggregate(byplace, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    fresh = F.when(F.col("__pii_spans").isNotNull(), done).otherwise(docs["text"])
    columns = {"text": fresh} | ({"n_chars": F.when(F.col("__pii_spans").isNotNull(), F.length(fresh).cast("long")).otherwise(docs["n_chars"])} if "n_chars" in docs.columns else {})
    return joined.select(*[columns[c].alias(c) if c in columns else docs[c] for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
