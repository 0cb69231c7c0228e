"""URL filters: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over the URL; a term counts
where no letter or digit stands beside it. One strict term rejects, and so do several different soft terms
whose weights reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The vocabulary that is used by default, and the weight from which soft terms reject: three light terms, or a
#: heavy one and any other.
TERMS, SOFT_LIMIT = Path(__file__).with_name("url_terms.tsv"), 2.5


@lru_cache
def vocabulary(path: str | Path = TERMS) -> tuple[list[str], dict[str, float]]:
    """Strict terms and the weights of soft ones from a file of ``term <tab> strict|soft <tab> weight`` lines."""
    rows = [line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip() and line[0] != "#"]
    wrong = [r for r in rows if len(r) != 3 or r[1] not in ("strict", "soft") or not r[0]]
    if wrong:
        raise ValueError(f"{path}: no term, kind and weight in {wrong[0]}")
    return [t for t, kind, _ in rows if kind == "strict"], {t: float(w) for t, kind, w in rows if kind == "soft"}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int) -> Column:
    """The longest rule that fits (longer host first among equals), as text or as its verdict; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, F.lit(r[1] + r[2] if field else r[0])).otherwise(out)
    return out


def automaton(strict: Sequence[str], soft: Mapping[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        out.add_word(term, (term, term in strict, soft.get(term, 0.0)))
    out.make_automaton()
    return out


def weighed(url: str, terms: ahocorasick.Automaton) -> tuple[int, int, float]:
    """Different strict terms, different soft terms and the soft terms' weight."""
    url = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    beside = lambda i: 0 <= i < len(url) and url[i].isascii() and url[i].isalnum()
    found = {v for end, v in terms.iter(url) if not beside(end + 1) and not beside(end - len(v[0]))}
    return sum(v[1] for v in found), sum(not v[1] for v in found), sum(v[2] for v in found if not v[1])


def url_vocabulary(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] | None = None, soft: Mapping[str, float] | None = None, limit: float = SOFT_LIMIT) -> DataFrame:
    """Every URL's host, path, rule and verdict, and its different strict and soft terms.

    The longest rule that fits decides; without one, a strict term or soft terms of weight ``limit``
    block. A null URL, or one without ``://``, has an empty host and path; its vocabulary still counts
    (null: none, so allow). Rows are judged alone: repeated rows repeat, an empty table gives none. The terms
    are those of ``TERMS`` unless given.
    """
    strict, soft = vocabulary()[0] if strict is None else strict, vocabulary()[1] if soft is None else soft
    if not any([*strict, *soft]):
        raise ValueError("the vocabulary is empty")

    @F.arrow_udf("struct<strict: int, soft: int, weight: double>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(strict, soft)
        for urls in batches:
            rows = [weighed(u or "", machine) for u in urls.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["strict", "soft", "weight"])

    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), terms(F.col(url)).alias("found"))
    host, path = F.col("host"), F.col("path")
    own = F.when((F.col("found.strict") > 0) | (F.col("found.weight") >= limit), "block").otherwise("allow")
    return parts.select(F.col("key").alias(key), "host", "path", rule_of(host, path, rules, 1).alias("rule"), F.coalesce(rule_of(host, path, rules, 0), own).alias("verdict"), F.col("found.strict").alias("n_strict"), F.col("found.soft").alias("n_soft"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, limit: float = SOFT_LIMIT) -> str:
    """The same as DuckDB SQL over ``pages``."""
    strict, soft = vocabulary()
    has = lambda t: f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)"
    n_strict = " + ".join(map(has, strict))
    n_soft = " + ".join(map(has, soft))
    weight = " + ".join(f"{w} * {has(t)}" for t, w in soft.items())
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in longest)
    said = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in longest)
    return f"""
WITH t AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u FROM pages),
v AS (SELECT *, {n_strict} AS n_strict, {n_soft} AS n_soft, {weight} AS weight FROM t)
SELECT page_id, host, path, CASE {rule} END AS rule,
 CASE {said} WHEN n_strict > 0 OR weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM v"""
