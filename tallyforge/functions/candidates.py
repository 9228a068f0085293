"""Rules over one candidate's fields, as column expressions: types, trust, sinks, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weakness numbers of vulnerability types.
WEAKNESS = {
    "integer_overflow_to_memory_access": "CWE-190", "integer_underflow_to_memory_access": "CWE-191", "signed_conversion_to_memory_access": "CWE-195",
    "integer_truncation_to_memory_access": "CWE-681", "format_string": "CWE-134", "credential_disclosure": "CWE-798", "hardcoded_credential": "CWE-798", "auth_bypass": "CWE-862",
}
#: Calls that copy without a bound.
UNBOUNDED_CALLS = ("gets", "strcpy", "strcat", "sprintf", "vsprintf")
#: Calls of broken ciphers and digests.
WEAK_CRYPTO = ("md5", "sha1", "des_set_key", "evp_md5", "evp_sha1", "weak_crypto")
#: Phrases of a capacity's basis that no report rests on.
WEAK_BASES = ("merged_stack_region", "contiguous_stack_region", "decompiler local fragment")
#: Integer argument registers by architecture.
ARGUMENT_REGISTERS = {"x86_64": ("rdi", "rsi", "rdx", "rcx", "r8", "r9"), "aarch64": tuple(f"x{i}" for i in range(8)), "arm": ("r0", "r1", "r2", "r3")}


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def _any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def memory_type(vulnerability_type: Column, kind: Column, destination: Column) -> Column:
    """The memory fault that a kind of access to a kind of destination would be."""
    kind, destination = _low(kind), _low(destination)
    read = (F.coalesce(vulnerability_type, F.lit("")) == "out_of_bounds_read") | kind.contains("load") | kind.startswith("read")
    return F.when(read, "out_of_bounds_read").when(destination.contains("heap"), "heap_overflow").when(destination.contains("stack"), "stack_overflow").otherwise("out_of_bounds_write")


def grounded_read(kind: Column, relation: Column, verdict: Column, address: Column, path_valid: Column, input_reaches: Column) -> Column:
    """Reads need a proven range, or an exact place on a valid path that input reaches; other kinds pass."""
    exact = (F.coalesce(address, F.lit("")) != "") & F.coalesce(path_valid, F.lit(False)) & F.coalesce(input_reaches, F.lit(False))
    proven = F.coalesce(relation == "proven_oob_read", F.lit(False)) | F.coalesce(verdict == "overflow", F.lit(False))
    return F.coalesce(kind != "out_of_bounds_read", F.lit(True)) | proven | exact


def weak_object(verdict: Column, split: Column, basis: Column, source: Column) -> Column:
    """An overflow whose object is likely an artifact of decompilation."""
    text = F.lower(F.concat_ws(" ", F.coalesce(basis, F.lit("")), F.coalesce(source, F.lit(""))))
    return F.coalesce(verdict.isin("overflow", "unbounded"), F.lit(False)) & (F.coalesce(split == "likely_decompiler_split", F.lit(False)) | _any(text, WEAK_BASES))


def guess_weakness(vulnerability_type: Column, kind: Column, sink: Column, relation: Column, destination: Column) -> Column:
    """CWE name of a candidate: by its type, else by its call, else by its destination."""
    named = F.element_at(F.create_map(*[F.lit(x) for pair in WEAKNESS.items() for x in pair]), vulnerability_type)
    read = F.when(kind == "source_read", "CWE-126").otherwise("CWE-125")
    unbounded = _low(sink).isin(*UNBOUNDED_CALLS) | (_low(relation) == "unbounded")
    return F.when(vulnerability_type == "out_of_bounds_read", read).otherwise(
        F.coalesce(F.when(vulnerability_type.isNotNull(), named), F.when(unbounded, "CWE-120"), F.when(_low(destination).contains("stack"), "CWE-121"), F.lit("CWE-787"))
    )


def haystack(scalars: Sequence[Column], lists: Sequence[Column]) -> Column:
    """All of a record's words in lower case, one field a line."""
    lines = [F.coalesce(c.cast("string"), F.lit("")) for c in scalars] + [F.coalesce(F.array_join(c, " "), F.lit("")) for c in lists]
    return F.lower(F.concat_ws("\n", *lines))


def may_call(text: Column, names: Sequence[str]) -> Column:
    """Cheap test before parsing: a bracket, and any of the names anywhere. Stays below UDFs in a plan."""
    low = _low(text)
    return low.contains("(") & _any(low, names)


def weak_crypto(observed: Column, name: Column) -> Column:
    called = F.regexp_replace(F.lower(F.coalesce(F.when(observed != "", observed), name)), "^_+", "")
    return F.coalesce(called.isin(*WEAK_CRYPTO), F.lit(False))


def tls_disabled(name: Column, mode: Column, option: Column, value: Column) -> Column:
    """Calls that switch certificate checks off."""
    bare = lambda c, extra="": F.regexp_replace(F.coalesce(c, F.lit("")), rf"[()\s{extra}]", "")
    verify = F.lower(bare(mode)).isin("0", "0x0", "ssl_verify_none")
    curl = F.upper(bare(option)).isin("CURLOPT_SSL_VERIFYPEER", "CURLOPT_SSL_VERIFYHOST") & F.lower(bare(value, "ULul")).isin("0", "0x0")
    out = F.when(name == "disable_tls_verify", True).when(name == "ssl_ctx_set_verify", verify).when(name == "curl_easy_setopt", curl)
    return F.coalesce(out, F.lit(False))


def private_key(value: Column) -> Column:
    """A PEM private key whose body is base64 of a long enough, varied ASN.1 sequence."""
    text = F.regexp_replace(F.replace(value, F.lit("\\n"), F.lit("\n")), r"^\s+|\s+$", "")
    shape = r"(?s)^-----BEGIN ((?:RSA |EC |OPENSSH )?PRIVATE KEY)-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END \1-----$"
    body = F.regexp_replace(F.regexp_extract(text, shape, 2), r"\s+", "")
    whole = body.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    code = F.hex(F.unbase64(F.when(whole, body)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(2)) - 1, F.lit(2)), lambda i: F.substring(code, i, F.lit(2)))
    return F.coalesce(text.rlike(shape) & (F.length(code) >= 32) & code.startswith("30") & (F.size(F.array_distinct(pairs)) >= 8), F.lit(False))


def sink_name(name: Column, kind: Column) -> Column:
    """memory_read, memory_write, or the call's name as a token."""
    name, kind = _low(name), _low(kind)
    has = lambda words: _any(name, words) | _any(kind, words)
    token = F.regexp_replace(F.regexp_replace(F.when(name != "", name).otherwise(kind), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(has(("load", "read")), "memory_read").when(has(("store", "write")), "memory_write").otherwise(token)


def trace_tokens(steps: Column) -> Column:
    """JSON list of each step's kind, else role, else name. ``steps``: array<struct<kind, role, name>>."""
    first = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    return F.to_json(F.transform(F.coalesce(steps, F.array().cast("array<struct<kind:string,role:string,name:string>>")), lambda x: first(x["kind"], x["role"], x["name"])))


def expectation_label(c: Column) -> Column:
    """Lower case; every character but letters and digits is an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_low(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def pair_token(c: Column) -> Column:
    """Names and addresses that differ between builds become placeholders."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\bFUN_[0-9a-f]+\b", "FUN")
    return F.regexp_replace(out, r"(?i)\b0x[0-9a-f]+\b", "0xADDR")


def unsupported_category(reason: Column) -> Column:
    """Why input could not be modelled: a named part, ``ambiguous``, or what stands before the colon."""
    text = F.coalesce(reason, F.lit(""))
    before = F.substring_index(text, ":", 1)
    return (
        F.when(text.startswith("unsupported_process_input_model:"), "process_input_model")
        .when(text.contains("unsupported_process_input_setup"), "process_input_setup")
        .when(text.contains("unsupported_process_input_source"), "process_input_source")
        .when(text.contains("ambiguous"), "ambiguous")
        .when(before != "", before)
        .otherwise("unsupported")
    )


def object_trust(basis: Column, kind: Column) -> Column:
    basis = _low(basis)
    return (
        F.when(basis.contains("declared") | basis.contains("ghidra"), "high")
        .when(kind.isin("global", "static_local", "tls", "struct_field"), "metadata")
        .when(kind.isin("inferred_frame_slice", "merged_frame_region"), "low")
        .otherwise("medium")
    )


def capacity_model(size: Column, expression: Column, low: Column, high: Column, source: Column, trust: Column) -> Column:
    """struct of a capacity; a positive fixed size leaves no symbolic expression."""
    fixed = F.when(size > 0, size.cast("long"))
    text = F.when(fixed.isNull(), F.coalesce(expression, F.lit(""))).otherwise("")
    return F.struct(fixed.alias("fixed_bytes"), text.alias("symbolic_expr"), low.cast("long").alias("lower_bound"), high.cast("long").alias("upper_bound"), F.coalesce(source, F.lit("")).alias("source"), trust.alias("trust"))


def argument_register(architecture: Column, position: Column) -> Column:
    """Register of the argument at a position from 0; NULL beyond the registers or for other architectures."""
    families = F.create_map(*[x for a, regs in ARGUMENT_REGISTERS.items() for x in (F.lit(a), F.array(*[F.lit(r) for r in regs]))])
    return F.get(F.try_element_at(families, architecture), position)


def effective_address(base: Column, index: Column, scale: Column, displacement: Column, bits: int | None = None) -> Column:
    """base + index * scale + displacement, exact; modulo the width where one is given."""
    wide = lambda c: c.cast("decimal(38,0)")
    out = wide(base) + wide(displacement) + F.coalesce(wide(index) * wide(scale), F.lit(0).cast("decimal(38,0)"))
    out = wide(out)
    return out if bits is None else F.pmod(out, F.lit(str(2**bits)).cast("decimal(38,0)"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six places, half to even on the decimal value of the quotient; 0.0 of nothing."""
    return F.coalesce(F.when(whole != 0, F.bround((part / whole).cast("decimal(38,18)"), 6).cast("double")), F.lit(0.0))


def linear_bound(scale: Column, constant: Column, op: Column, value: Column, reject: Column) -> Column:
    """struct<lower, upper> of x from ``scale * x + constant op value``; a rejected test bounds by its opposite.

    NULL for a scale that is not positive, or another comparison.
    """
    opposite = F.create_map(*[F.lit(x) for pair in ((">=", "<"), (">", "<="), ("<=", ">"), ("<", ">=")) for x in pair])
    way = F.when(reject, F.try_element_at(opposite, op)).otherwise(op)
    exact = (value - constant) / scale
    lower = F.when(way == ">=", F.ceil(exact)).when(way == ">", F.floor(exact) + 1)
    upper = F.when(way == "<=", F.floor(exact)).when(way == "<", F.ceil(exact) - 1)
    return F.when((scale > 0) & way.isin(">=", ">", "<=", "<"), F.struct(lower.cast("long").alias("lower"), upper.cast("long").alias("upper")))


def replace_paths(value: Column, replacements: Mapping[str, str]) -> Column:
    """A JSON text, or any text, with path prefixes replaced in the order given."""
    for old, new in replacements.items():
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def chain_text(hops: Column) -> Column:
    """``a -> b -> c`` of connected hops, forwards or backwards; else all hops, one by one.

    ``hops``: array<struct<caller, callee>>.
    """
    n = F.size(hops)

    def linked(x: Column) -> Column:
        joints = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.coalesce(F.try_element_at(x, i)["caller"] == F.try_element_at(x, i - 1)["callee"], n < 2))
        return F.forall(joints, lambda ok: ok)

    def path(x: Column) -> Column:
        return F.array_join(F.concat(F.array(F.element_at(x, 1)["caller"]), F.transform(x, lambda h: h["callee"])), " -> ")

    apart = F.array_join(F.transform(hops, lambda h: F.concat(F.coalesce(h["caller"], F.lit("")), F.lit(" -> "), F.coalesce(h["callee"], F.lit("")))), "; ")
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "").when(linked(hops), path(hops)).when(linked(F.reverse(hops)), path(F.reverse(hops))).otherwise(apart)
