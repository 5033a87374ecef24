"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

Each kind has a pattern, a check (digit counts, Luhn, parts of an address, mod-97, mixed characters) and a base score. A
known word within ``NEAR`` code points before or after a span raises its score, a word of made-up data lowers it. Kinds of
the base set are reported whatever their score; the others (account numbers, social security numbers, assigned secrets,
keys of known forms) where it reaches ``threshold``. Spans are in code points, end exclusive, leftmost and non-overlapping
within a kind; matches that fail their check are dropped and not retried.

All of it is DataFrame functions on one row: no shuffle. Patterns use possessive groups and start only where a run
of their characters starts (or the previous match ended), which finds the same matches as the plain patterns in
linear time and without recursion.

Edge cases: null and empty texts have no spans; an empty table gives no rows; rows are judged each; columns of the
input named like the result's are replaced, others are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let

#: Code points before and after a span in which context words count.
NEAR = 40
#: Words of made-up data, which lower a score.
AGAINST = "example|sample|dummy|placeholder"
_BLOCK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, with its first four characters at the end."""
    turned = F.concat(F.substring(account, 5, 1 << 30), F.substring(account, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _small_parts(m: Column) -> Column:
    def part(p: Column) -> Column:
        z = F.ltrim(p, F.lit("0"))
        return (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255"))

    return F.forall(F.split(m, r"\."), part)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column) -> Column:
    return let(_only_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _mixed(m: Column) -> Column:
    """Whether an assigned value has letters, digits and at least eight distinct characters."""
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_.~-]{12,}+)={0,2}[\x22']?\z", 1)
    return let(value, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # what every match contains
    check: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "mail|email|e-mail|contact"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _small_parts, 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_only_digits(m)).between(10, 15), 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.8, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (m < "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), 0.3, "ssn|social|security", False),
    # a name of a secret, an assignment, a value
    Kind("secret", r"(?<![A-Za-z0-9])(?i:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)(?:[_-][A-Za-z0-9]{1,20}+){0,3}+[\x22']?\x20{0,3}+(?:=>|:=|[=:])\x20{0,3}+[\x22']?[A-Za-z0-9+/_.~-]{12,}+={0,2}+[\x22']?", "", _mixed, 0.7, "key|secret|token|password|credential|auth", False),
    # public forms of access keys, of signed tokens and of private keys' headings
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])|-----BEGIN\x20(?:(?!PRIVATE\x20)[A-Z]++\x20)*+PRIVATE\x20KEY-----", "", lambda m: F.lit(True), 0.8, "key|secret|token", False),
)


def prefix_sums(a: Column) -> Column:
    """Inclusive prefix sums, in blocks, so that long arrays take no square time."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(a) - 1)), lambda j: add(F.slice(a, j * _BLOCK + 1, _BLOCK)))
        return let(blocks, lambda t: F.transform(a, lambda x, i: add(F.slice(t, F.lit(1), block(i))) + add(F.slice(a, block(i) * _BLOCK + 1, i % _BLOCK + 1))))

    return let(a, of)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, end, kind, score, text>> of one kind."""
    made = "array<struct<start:int,rank:int,end:int,kind:string,score:double,text:string>>"

    none_text = F.lit("")

    def of(matches: Column) -> Column:
        def found(between: Column) -> Column:
            gaps = F.transform(matches, lambda m, i: F.length(F.get(between, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
            near = lambda i, j, k: F.concat(*(F.coalesce(x, none_text) for x in (F.get(between, i), F.get(matches, j), F.get(between, k))))
            beside = lambda i: F.concat(F.right(near(i - 1, i - 1, i), F.lit(NEAR)), F.lit("\n"), F.left(near(i + 1, i + 1, i + 2), F.lit(NEAR)))
            return let(prefix_sums(gaps), lambda at: F.filter(F.transform(matches, lambda m, i: span(m, F.get(at, i), beside(i))), lambda s: s.isNotNull()))

        return let(F.split(text, kind.pattern, -1), found)

    def span(m: Column, at: Column, beside: Column) -> Column:
        said = lambda words: F.lower(beside).rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
        raised = F.when(said(kind.context), F.lit(0.3)).otherwise(F.lit(0.0)) - F.when(said(AGAINST), F.lit(0.3)).otherwise(F.lit(0.0))
        score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.score) + raised)), 2)
        row = F.struct(at.cast("int").alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).cast("int").alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), m.alias("text"))
        return F.when(kind.check(m), row)

    none = F.array().cast(made)
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(of(m).cast(made)))
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none) if kind.hint else found


def find(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with spans: array<struct<start, rank, end, kind, score, text>>, by start and kind."""
    base = [k.name for k in kinds if k.base]
    others = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(F.lit(0), *others).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = F.sort_array(F.concat(*(_spans(F.col("text"), k, i) for i, k in enumerate(kinds))))
    return rows.select(*(F.col("row")[c].alias(c) for c in others), F.filter(held, lambda s: s["kind"].isin(*base) | (s["score"] >= threshold)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id_col, n_<kind> of the base kinds, base_sha256, spans, n_spans, n_<kind> of the other kinds)."""
    base = [k.name for k in kinds if k.base]
    found = find(docs.select(id_col, text_col), text_col, kinds=kinds)
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    of_base = listed(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return found.select(id_col, *(count(k) for k in base), F.sha2(of_base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *(count(k.name) for k in kinds if not k.base))


def masked(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; of overlapping spans the first counts."""
    found = find(docs, text_col, threshold)

    def put(acc: Column, s: Column) -> Column:
        after = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(after.alias("out"), s["end"].alias("at")))

    whole = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, 1 << 30)))
    return found.withColumn(text_col, whole).drop("spans")
