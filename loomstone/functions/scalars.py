"""Scalar operators as Column expressions: information, activation, sets, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of link confidences; an unknown one counts as UNKNOWN_CONFIDENCE.
CONFIDENCE = {"extracted": 1.0, "inferred": 0.5, "ambiguous": 0.15}
UNKNOWN_CONFIDENCE = 0.5
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def r6(x: Column) -> Column:
    """Six decimals, half up on the binary value: the same in every engine."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def surprisal(df: Column, corpus: Column) -> Column:
    """Bits of seeing a term of document frequency df in a corpus; 0 for an empty corpus."""
    return F.when(corpus <= 0, F.lit(0.0)).otherwise(-F.log2(F.least(F.lit(1.0), F.greatest(df, F.lit(1)) / corpus)))


def normalised_entropy(weights: Column) -> Column:
    """Entropy of the positive weights of an array over its maximum; 0 below two of them."""
    positive = F.filter(weights, lambda w: w > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, w: a + w)
    bits = F.aggregate(positive, F.lit(0.0), lambda a, w: a - (w / total) * F.log2(w / total))
    return F.when(F.size(positive) < 2, F.lit(0.0)).otherwise(bits / F.log2(F.size(positive)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def activation(uses: Column, age_days: Column, decay: float = 0.5) -> Column:
    """Base-level activation ln(n / (1 - d)) - d ln(age); minus infinity without uses."""
    return F.when(uses <= 0, F.lit(float("-inf"))).otherwise(F.log(uses / F.lit(1 - decay)) - F.lit(decay) * F.log(F.greatest(age_days, F.lit(1 / 24))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), x))))


def retrieval_probability(act: Column, tau: float = 0.0, noise: float = 0.4) -> Column:
    return F.when(act == F.lit(float("-inf")), F.lit(0.0)).otherwise(logistic((act - F.lit(tau)) / F.lit(max(noise, 1e-6))))


def review_gain(p: Column) -> Column:
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
    return 4 * q * (1 - q)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, a zero norm replaced by one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    return dot / (norm(a) * norm(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column, edges: tuple[int, ...] = (0, 7, 14, 21, 28, 36, 43, 50, 57, 64)) -> Column:
    """The bit bands of a 64-bit sketch: two sketches at most len(edges) - 2 bits apart share one."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("key")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])


def confidence_weight(confidence: Column) -> Column:
    out = F.lit(UNKNOWN_CONFIDENCE)
    for name, w in CONFIDENCE.items():
        out = F.when(confidence == name, F.lit(w)).otherwise(out)
    return out


def member_id(members: Column, prefix: str = "thm_", digits: int = 12) -> Column:
    """An opaque id of a set of strings; member_id(x, "", 16) over distinct members is a pattern's key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), 256), 1, digits))


def plain_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def same_author(claimed: Column, author: Column) -> Column:
    """Last names equal, and each other claimed name begins some name of the author."""
    c, a = F.split(plain_key(claimed), " "), F.split(plain_key(author), " ")
    return (F.element_at(c, -1) == F.element_at(a, -1)) & F.forall(F.slice(c, F.lit(1), F.size(c) - 1), lambda t: F.exists(a, lambda n: F.startswith(n, t)))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the distinct query terms in a text's terms."""
    q = F.array_distinct(query)
    return F.size(F.array_intersect(q, text)) / F.greatest(F.size(q), F.lit(1))


def as_of(valid_at: Column, invalid_at: Column, moment: str) -> Column:
    """Bi-temporal validity by prefixes of ISO text at the precision of ``moment``; null is unbounded."""
    k = len(moment)
    zulu = lambda c: F.regexp_replace(c, "\\+00:00$", "Z")
    m = moment.replace("+00:00", "Z")
    return (valid_at.isNull() | (F.substring(zulu(valid_at), 1, k) <= m)) & (invalid_at.isNull() | (F.substring(zulu(invalid_at), 1, k) > m))


def reading_cost(words: Column) -> Column:
    return F.greatest(F.lit(2.0), F.round(words / 150.0, 1))


def titleize(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", ""), "[-_]", " ")


def render_id(value: Column) -> Column:
    """A 63-bit id as 13 Crockford base-32 digits."""
    return F.concat(*[F.substring(F.lit(CROCKFORD), F.shiftrightunsigned(value, s).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for s in range(60, -1, -5)])


def parse_id(text: Column) -> Column:
    """Back from render_id."""
    chars = F.split(F.upper(text), "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(F.shiftleft(a, 5).bitwiseOR((F.instr(F.lit(CROCKFORD), c) - 1).cast("long"))))


def id_parts(value: Column) -> Column:
    """Milliseconds since 2026-01-01, module, algorithm and sequence of an id (41, 6, 6 and 10 bits)."""
    return F.struct(
        F.timestamp_millis(F.shiftrightunsigned(value, 22) + F.lit(1767225600000)).alias("at"),
        F.shiftrightunsigned(value, 16).bitwiseAND(F.lit(63)).alias("module"),
        F.shiftrightunsigned(value, 10).bitwiseAND(F.lit(63)).alias("algorithm"),
        value.bitwiseAND(F.lit(1023)).alias("sequence"),
    )


def invalid_citations(text: Column, evidence: Column) -> Column:
    """Citation numbers [n] of one or two digits, not links, outside 1..evidence."""
    found = F.transform(F.regexp_extract_all(text, F.lit("\\[(\\d{1,2})\\](?!\\()"), F.lit(1)), lambda x: x.cast("int"))
    return F.filter(found, lambda n: (n < 1) | (n > evidence))


def delivery_budget(load: Column) -> Column:
    """struct(limit, tokens, concise) for a declared cognitive load from 1 to 5."""
    pick = lambda high, low, mid: F.when(load >= 4, F.lit(high)).when(load <= 2, F.lit(low)).otherwise(F.lit(mid))
    return F.struct(pick(5, 8, 8).alias("evidence"), pick(512, 1536, 1024).alias("tokens"), (load >= 4).alias("concise"))


def privacy_of(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first matching glob's value."""
    out = F.lit(default)
    for glob, value in reversed(rules):
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c for c in glob) + "$"
        out = F.when(path.rlike(pattern), F.lit(value)).otherwise(out)
    return out
