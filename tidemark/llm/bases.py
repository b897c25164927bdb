"""What SQL can express of operators that it can't express whole: queries over the operators' own results, with their SQL.

``mixing_targets``: sizes and targets of op7; ``secret_counts``: the pattern counts of op9; ``unigram_base``: the counts and base
scores of op8, by its own steps but without its network, which they don't need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import WORD

#: Words of a text in SQL.
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_LOW = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
#: crc32 of an id's digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, (b & 1) * 3988292384))))"


def mixing_targets(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: A unit of weight is what is left of the share over the weights left, once the sources of least room for their weight have all that they may.
MIXING_SQL = f"""
    WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, {mixing.MOST} * n AS room, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {mixing.SHARE} * sum(n) OVER () AS share FROM s),
    o AS (SELECT *, share - coalesce(sum(room) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights, row_number() OVER (ORDER BY room / weight, k) AS place FROM w
          WINDOW before AS (ORDER BY room / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    u AS (SELECT arg_min(rest / weights, place) AS unit FROM o WHERE rest / weights * weight <= room),
    t AS (SELECT source, n, CASE WHEN unit IS NULL OR unit * weight > room THEN room ELSE unit * weight END AS target FROM w, u)
    SELECT doc_id, size, n AS source_size, ROUND(CAST(target AS DOUBLE), 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""


def secret_counts(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex")


_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join([*map(_EITHER, ("password", "passwd", "secret", "token")), _EITHER("api") + "_?" + _EITHER("key")])
SECRETS_SQL = f"""
    SELECT doc_id,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 12)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) AS BIGINT) AS n_access,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 16)) AS BIGINT) AS n_hex
    FROM documents"""


def unigram_base(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out, list_append({_LOW}, chr(10)) AS words FROM documents),
    t AS (SELECT row, held_out, unnest(words) AS word FROM d),
    c AS (SELECT word, count(*) AS n FROM t WHERE NOT held_out GROUP BY word),
    z AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) AS many FROM c),
    g AS (SELECT row, count(*) AS n_tokens, count(c.n) AS n_known, sum(log10(coalesce(c.n, 0) + 1)) AS logs FROM t LEFT JOIN c USING (word) GROUP BY row)
    SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, ROUND(logs - n_tokens * log10(CAST(total + many + 1 AS DOUBLE)), 4) AS base_score
    FROM d JOIN g USING (row), z"""


#: Name: the operator's query, what it keeps of its result, and the SQL.
BASES: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str]] = {
    "mixing_targets": ("op7_mixing", mixing_targets, MIXING_SQL),
    "secret_counts": ("op9_secret_scan", secret_counts, SECRETS_SQL),
    "unigram_base": ("op8_base", unigram_base, BASE_SQL),
}
