"""Scalar text functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Empty or blank text as NULL."""
    return F.when(F.trim(c) != "", c)


def normalize_reason(c: Column) -> Column:
    """Blocker reason with addresses and numbers as placeholders; empty gives ``unknown``."""
    x = F.lower(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(F.regexp_replace(x, "0x[0-9a-f]+", "<address>"), r"\b\d+\b", "<n>")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9_< >]+", "_"), "_+", "_")
    x = F.regexp_replace(x, "^[_ ]+|[_ ]+$", "")
    return F.when(x == "", "unknown").otherwise(x)


def reason_category(c: Column) -> Column:
    """First of six categories whose words occur; NULL if none."""
    x = F.lower(c)
    return (
        F.when(x.contains("unsupported"), "unsupported")
        .when(x.rlike("missing|not found|unavailable"), "missing")
        .when(x.rlike("timeout|timed out"), "timeout")
        .when(x.contains("unresolved"), "unresolved")
        .when(x.contains("blocked"), "blocked")
        .when(x.contains("requires"), "requires")
    )


#: Ordered stages and the words that name them.
STAGES = {
    "detection_gap": ["detection", "undetected"],
    "exact_sink": ["sink", "exact_operation"],
    "input_topology": ["input", "topology"],
    "process_trigger": ["process", "trigger"],
    "runtime_semantics": ["runtime", "semantics"],
    "exploration": ["exploration", "timeout"],
    "proof_relation": ["proof", "relation"],
}


def blocker_stage(given: Column, reason: Column) -> Column:
    """The given stage if valid, else the first stage one of whose words occurs, else proof_relation."""
    out = F.when(given.isin(*STAGES), given)
    for stage, words in STAGES.items():
        out = out.when(F.lower(reason).rlike("|".join(words)), stage)
    return out.otherwise("proof_relation")


def token_shape(c: Column, least: int = 20, classes: int = 3, distinct: int = 10) -> Column:
    """Looks like a credential token: long, several character classes, diverse."""
    x = F.regexp_replace(c, "^[\"']+|[\"']+$", "")
    count = sum((F.when(x.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[_.-]")), F.lit(0))
    different = F.size(F.array_distinct(F.split(x, "")))
    shape = x.rlike(r"^[A-Za-z0-9_.-]{" + str(least) + ",}$")
    example = F.lower(x).rlike("example|template|placeholder|changeme|your_|xxxx")
    return F.coalesce(shape & ~example & (count >= classes) & (different >= distinct) & (different > F.floor(F.length(x) / 4)), F.lit(False))


def placeholder(c: Column) -> Column:
    """One repeated character, or an example or template word."""
    one = F.size(F.array_distinct(F.split(c, ""))) == 1
    return F.coalesce(one | F.lower(c).rlike("example|placeholder|changeme|dummy|sample|<[^>]*>|\\$\\{"), F.lit(True))


def fingerprint(c: Column) -> Column:
    """Only the hash of a literal leaves the engine."""
    return F.substring(F.sha2(c, 256), 1, 16)


def stable_id(*parts: Column, sep: str = "|") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def operation_name(c: Column) -> Column:
    """Canonical call name: no namespace, version suffix, builtin prefix or leading underscores."""
    x = F.regexp_replace(F.regexp_replace(F.trim(c), "@.*$", ""), "^.*::", "")
    x = F.regexp_replace(F.regexp_replace(x, "^_*builtin_", ""), "^_+", "")
    return F.when(c.rlike(r"operator\s+new"), "operator_new").when(c.rlike(r"operator\s+delete"), "operator_delete").otherwise(F.lower(x))


def address(c: Column) -> Column:
    """0x-prefixed lower-case hex without leading zeros; NULL if it is none."""
    x = F.regexp_extract(F.lower(F.trim(c)), r"^(?:0x)?([0-9a-f]+)$", 1)
    short = F.regexp_replace(x, "^0+(?=.)", "")
    return F.when(x != "", F.concat(F.lit("0x"), short))


def address_number(c: Column) -> Column:
    return F.conv(F.substring(address(c), 3, 16), 16, 10).cast("decimal(20,0)")


def integer_literal(c: Column) -> Column:
    """C integer literal (hex, octal, decimal, char; suffixes dropped) of up to 64 bits as decimal(20,0); NULL if none."""
    x = F.regexp_replace(F.lower(F.trim(c)), "[ul]+$", "")
    sign = F.when(x.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(x, "^[-+]", "")
    return (
        F.when(body.rlike("^0x0*[0-9a-f]{1,16}$"), F.conv(F.regexp_replace(F.substring(body, F.lit(3), F.length(body)), "^0+(?=.)", ""), 16, 10).cast("decimal(20,0)") * sign)
        .when(body.rlike("^0[0-7]+$"), F.conv(body, 8, 10).cast("decimal(20,0)") * sign)
        .when(body.rlike("^[0-9]{1,20}$"), F.when(body.rlike("^[0-9]{1,20}$"), body).try_cast("decimal(20,0)") * sign)
        .when(F.trim(c).rlike("^'[^'\\\\]'$"), F.ascii(F.substring(F.trim(c), 2, 1)).cast("decimal(20,0)"))
    ).cast("decimal(20,0)")


def cwe(c: Column) -> Column:
    """CWE-n names in a text, in order, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"CWE[-_ ]?0*(\d+)"), F.lit(1)), lambda x: F.concat(F.lit("CWE-"), x)))


def binary_key(c: Column) -> Column:
    """Comparable name of a binary: base name, lower case, without build suffixes."""
    base = F.element_at(F.split(F.lower(c), "[/\\\\]"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"\.(?:exe|elf|bin|out|o)$", ""), "[^a-z0-9_]+", "_")


def stack_offset(n: Column) -> Column:
    """+0x10 / -0x8 notation."""
    return F.concat(F.when(n < 0, "-0x").otherwise("+0x"), F.lower(F.hex(F.abs(n))))


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 4).when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def token_score(tokens: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the words that occur in any token."""
    hay = F.lower(F.array_join(tokens, "\n"))
    return sum((F.when(hay.contains(w), v).otherwise(0.0) for w, v in weights.items()), F.lit(0.0))


def routes(text: Column) -> Column:
    """Distinct absolute paths of addresses in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^/\s\"'<>]+(/[A-Za-z0-9_./-]*)"), F.lit(1)))


_CAST = r"\((?:unsigned|signed|const|struct)?(?:int|char|long|short|void|byte|uint|size_t|undefined\d?|u?int\d+_t)\**\)"


def cast_stripped(c: Column) -> Column:
    """C expression without casts, doubled or enclosing parentheses and blanks, to the fixpoint.

    Each round removes a nesting level at least, so as many rounds as there are opening
    parentheses reach it.
    """
    def once(x: Column) -> Column:
        x = F.regexp_replace(x, _CAST, "")
        return F.regexp_replace(F.regexp_replace(x, r"\(\(([^()]*)\)\)", "($1)"), r"^\(([^()]*)\)$", "$1")

    x = F.regexp_replace(c, r"\s+", "")
    rounds = F.sequence(F.lit(0), F.length(x) - F.length(F.replace(x, F.lit("("), F.lit(""))))
    return F.aggregate(rounds, x, lambda y, _: once(y))
