"""Personal data: patterns propose spans, checksums confirm them, context words set the score.

Every kind has one pattern, written so that the leftmost match of the plain form is found without rescanning: a match may
only begin where a run of its leading characters begins or where the previous match ended (``\\G``), and repeats are
possessive.  Besides the contract's four kinds there are bank accounts (mod-97), access keys and assigned passwords (their
values must look random) and national identity numbers (check letter, or the ranges that are given out).  That keeps the matcher linear on very long texts and its stack flat; the spans are the same.

Offsets come from cutting the text at the matches: start = characters before it.  Everything is a SQL expression over
the document's own row, so there is no shuffle and no skew.

Defined cases: a null text is empty and has no spans; columns other than the id and the text are ignored; an empty table
gives an empty result; repeated rows are treated one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.numbers import let

#: Kinds in the order of the contract; those after the fourth are added by this operator.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "national")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_KNOWN = "(?:" + "|".join(" ".join(IBAN_LENGTHS.values()).split()) + ")[0-9]{2}"
_BY_LENGTH = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: How well-known access keys begin and how long they are; names that a secret is assigned to; the check letters
#: of Spanish identity numbers, by the number modulo 23.
KEY_FORMS = r"A[KS]IA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|AIza[A-Za-z0-9_-]{35}|xox[abp]-[A-Za-z0-9-]{20,80}"
SECRET_NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: A secret's value: at least this many characters, and as many different ones.
_VALUE, SECRET_KINDS = r"[A-Za-z0-9+/_~-]{11,}[A-Za-z0-9]", 8
_SECRET = rf"(?:{KEY_FORMS}|(?i:{SECRET_NAMES})\x20?[:=]\x20?[\x22\x27]?{_VALUE})"
_NATIONAL = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal chain of digits with single separators; only chains of 14 to 19 digits can pass.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A known country's IBAN ends at its length; another's runs on, but not into the start of a known one.
    "iban": rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{_KNOWN})[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
    # An access key of a known form, or the assignment of a value to a secret's name.
    "secret": rf"(?<![A-Za-z0-9_]){_SECRET}(?![A-Za-z0-9_])",
    # A US social security number, or a Spanish identity number.
    "national": rf"(?<![A-Za-z0-9_]){_NATIONAL}(?![A-Za-z0-9_])",
}
#: Cheap tests that a text must pass before a pattern is run.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[:=]|A[KS]IA|gh[opsu]_|sk_live_|AIza|xox[abp]-", "national": r"[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]"}
#: Words near a span that raise its score, by kind.
CONTEXT = {
    "email": r"e-?mail|contact|correo|courriel|write to",
    "ip": r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server|adresse",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|mobile|fax|anruf|appel|llama",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "secret": r"login|credential|secret|private|auth|aws|config|passwort|contrase",
    "national": r"ssn|social security|dni|identity|identidad|passport",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.85, "secret": 0.7, "national": 0.5}
CONTEXT_BONUS = 0.15
CONTEXT_CHARS = 40
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    n = F.length(digits)
    doubled = lambda i: (n - i) % 2 == 1
    return (
        F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda acc, i: acc + F.when(doubled(i), F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)) >= "5", 9).otherwise(0)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
        )
        % 10
        == 0
    )


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10 over an IBAN without spaces: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    code = lambda c: F.ascii(c)
    return (
        F.aggregate(
            F.split(turned, "(?!^)"),
            F.lit(0),
            lambda acc, c: F.when(c == "", acc).when(code(c) >= 65, (acc * 100 + code(c) - 55) % 97).otherwise((acc * 10 + code(c) - 48) % 97),
        )
        == 1
    )


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(F.regexp_replace(match, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, r"\x20", ""))
    if kind == "secret":
        value = F.regexp_extract(match, _VALUE, 0)
        return (F.size(F.array_distinct(F.split(value, ""))) >= SECRET_KINDS) & (match.rlike(rf"^(?:{KEY_FORMS})$") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]")))
    if kind == "national":
        digits = F.substring(match, 1, 8).cast("int")
        social = ~match.rlike("^(?:000|666|9)|-00-|-0000$")
        return F.when(match.rlike("^[0-9]{8}"), F.right(match, F.lit(1)) == F.substring(F.lit(DNI_LETTERS), digits % 23 + 1, F.lit(1))).otherwise(social)
    return F.lit(True)


#: Arrays are added up and folded in runs of this many entries: a fold copies its state at every step, so none carries more than a run.
RUN = 256


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def _run_of(i: Column) -> Column:
    return F.floor(i / RUN).cast("int")


def _runs(array: Column) -> Column:
    return F.sequence(F.lit(0), _run_of(F.greatest(F.size(array) - 1, F.lit(0))))


def _run(array: Column, i: Column) -> Column:
    return F.slice(array, i * RUN + 1, F.lit(RUN))


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it: sums of runs first, then a run's own numbers."""

    def of_runs(all_: Column, sums: Column) -> Column:
        return let(F.transform(sums, lambda _, i: _total(F.slice(sums, F.lit(1), i))), lambda starts: F.transform(all_, lambda _, i: F.get(starts, _run_of(i)) + _total(F.slice(all_, _run_of(i) * RUN + 1, i % RUN))))

    return let(numbers, lambda all_: let(F.transform(_runs(all_), lambda i: _total(_run(all_, i))), lambda sums: of_runs(all_, sums)))


def candidates(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, as (start, rank of the kind, end, kind, score), ordered by start; linear in the text."""
    rank, pattern = KINDS.index(kind), PATTERNS[kind]
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)")

    def span(cut: Column, ends: Column, match: Column, i: Column) -> Column:
        before, after = F.get(cut, i), F.get(cut, i + 1)
        near = F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS))))
        score = F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        start = F.get(ends, i) + F.length(before)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(match)).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    def of_cut(found: Column, cut: Column) -> Column:
        # Where the match before each one ends.
        ends = sums_before(F.transform(found, lambda m, i: F.length(F.get(cut, i)) + F.length(m)))
        good = F.filter(F.transform(found, lambda m, i: F.struct(m.alias("match"), i.alias("i"))), lambda m: confirmed(kind, m["match"]))
        return let(ends, lambda e: F.transform(good, lambda m: span(cut, e, m["match"], m["i"])))

    # The text is cut at its matches only if there are any.
    of_found = lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda cut: of_cut(found, cut))).otherwise(none)
    return F.when(text.rlike(NEEDS[kind]), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_found)).otherwise(none)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all confirmed spans by start and kind, each with its score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col).alias("doc_id"), *(candidates(k, text).alias(k) for k in KINDS))
    return each.select("doc_id", F.sort_array(F.concat(*KINDS)).alias("spans"))


def _apart(spans: Column) -> Column:
    """Runs (at, spans) of the spans that none before them overlaps: ``at`` is where the last span of the runs before ends."""
    end = lambda run, at: F.aggregate(run, at, lambda a, s: F.when(s["start"] < a, a).otherwise(s["end"]))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)")

    def kept(run: Column, at: Column) -> Column:
        state = F.struct(at.alias("at"), none.alias("kept"))
        return F.aggregate(run, state, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["kept"], s).alias("kept"))), lambda acc: acc["kept"])

    def of_all(all_: Column) -> Column:
        begins = F.aggregate(_runs(all_), F.array(F.lit(0)), lambda acc, i: F.array_append(acc, end(_run(all_, i), F.element_at(acc, -1))))
        return let(begins, lambda at: F.transform(_runs(all_), lambda i: F.struct(F.get(at, i).alias("at"), F.get(at, i + 1).alias("to"), kept(_run(all_, i), F.get(at, i)).alias("spans"))))

    return let(spans, of_all)


def redact(docs: DataFrame, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents with every span that scores at least ``least`` replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first wins.  A run's stretch of the text is cut out first, then its spans from it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.filter(F.sort_array(F.concat(*(candidates(k, text) for k in KINDS))), lambda s: s["score"] >= least)

    def of_run(r: Column, stretch: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, r["at"]).otherwise(F.get(r["spans"], F.greatest(i - 1, F.lit(0)))["end"])
            return F.concat(F.substring(stretch, begin - r["at"] + 1, s["start"] - begin), F.lit("<"), s["kind"], F.lit(">"))

        return F.array_join(F.transform(r["spans"], piece), "")

    def of_runs(runs: Column) -> Column:
        done = F.transform(runs, lambda r: let(F.substring(text, r["at"] + 1, r["to"] - r["at"]), lambda stretch: of_run(r, stretch)))
        return F.concat(F.array_join(done, ""), F.substring(text, F.element_at(runs, -1)["to"] + 1, F.length(text)))

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(_apart(spans), of_runs)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts per base kind, a digest of the base spans, and all spans written out."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size("spans").cast("long").alias("n_spans"),
    )


# The same in DuckDB, from the plain patterns; checks are list expressions.  A word boundary stands for the IBAN's edges.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "secret": rf"\b{_SECRET}\b",
    "national": rf"\b{_NATIONAL}\b",
}
_CHECKS = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256))) <= 255",
    "card": "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 1 THEN CAST(d[k] AS INT) * 2 - CASE WHEN d[k] >= '5' THEN 9 ELSE 0 END ELSE CAST(d[k] AS INT) END)) % 10 = 0",
    "phone": "length(d) BETWEEN 10 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INT))), lambda a, c: (a * 10 + c) % 97) = 1",
    "secret": f"len(list_distinct(string_split(regexp_extract(v, '{_VALUE}'), ''))) >= {SECRET_KINDS} AND (regexp_full_match(v, '{KEY_FORMS}') OR (regexp_matches(regexp_extract(v, '{_VALUE}'), '[0-9]') AND regexp_matches(regexp_extract(v, '{_VALUE}'), '[A-Za-z]')))",
    "national": f"CASE WHEN regexp_matches(v, '^[0-9]{{8}}') THEN right(v, 1) = '{DNI_LETTERS}'[CAST(v[1:8] AS INT) % 23 + 1] ELSE NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') END",
}


def _oracle() -> str:
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS rank, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS s FROM t" for i, (k, p) in enumerate(_PLAIN.items()))
    checks = " OR ".join(f"(kind = '{k}' AND {c})" for k, c in _CHECKS.items())
    score = "CASE kind " + " ".join(f"WHEN '{k}' THEN {BASE_SCORE[k]} + CASE WHEN regexp_matches(near, '{CONTEXT[k]}') THEN {CONTEXT_BONUS} ELSE 0 END" for k in KINDS) + " END"
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({found}),
u AS (SELECT doc_id, kind, rank, f[i] AS v, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0)::BIGINT AS start,
  lower(right(s[i], {CONTEXT_CHARS}) || ' ' || left(s[i + 1], {CONTEXT_CHARS})) AS near FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0)),
c AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM u),
ok AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + length(v)) AS span, printf('%.2f', {score}) AS score FROM c WHERE {checks}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans, string_agg(score, ',' ORDER BY start, rank) AS scores FROM ok GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, ({' + '.join(f'coalesce(n_{k}, 0)' for k in KINDS)})::BIGINT AS n_spans FROM t LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
