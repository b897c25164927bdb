"""URL filter: host and path rules over a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over the lower-cased
url. A find counts only between boundaries (start, end or a character outside a-z and 0-9), and
each term counts once a url (of "free-bets" and "free" in one place, both). One strict term rejects; soft terms reject together, when the
weights of the distinct ones found reach ``soft_limit``. Rules go before the vocabulary.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a null
url holds no term and is allowed, an empty one too. Repeated rows are judged each for itself; null
ids stay null; further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

STRICT = (
    "adultfriend", "bestiality", "bitcoin-doubler", "blackjack", "camgirl", "camgirls", "carding", "casino", "casinos", "cialis", "cracked-apk", "creampie", "cumshot", "darknet-market",
    "deepnude", "ebony-porn", "erotica", "escort", "escorts", "fake-id", "fakeid", "fap", "fetish-porn", "fullz", "gangbang", "hardcore-porn", "hentai", "incest-porn", "keygen", "keygens", "levitra",
    "link-farm", "linkfarm", "live-sex", "malware", "milf", "naked-girls", "nsfw", "nudes", "online-casino", "onlyfans-leak", "payday-loan", "payday-loans", "phishing", "poker-online", "porn", "porno",
    "pornhub", "pornography", "pornstar", "pornstars", "ransomware", "sex-cam", "sexcam", "sextape", "slot-machine", "slots-online", "spam", "spam-farm", "spamfarm", "sportsbook", "strip-poker", "torrent-crack",
    "tramadol", "upskirt", "viagra", "voyeur", "warez", "webcam-sex", "xhamster", "xnxx", "xvideos", "xxx",
)
SOFT = {
    "ads": 1.0, "adult": 1.5, "adults": 1.0, "affiliate": 0.5, "babes": 1.5, "bet": 1.0, "bets": 1.0, "betting": 1.5, "bonus": 1.0, "bonuses": 1.0, "buy": 0.5, "buy-now": 1.0, "cash": 0.5, "cheap": 1.0,
    "click": 0.5, "clickbait": 1.0, "coupon": 0.5, "coupons": 0.5, "crack": 1.0, "cracked": 1.0, "credit": 0.5, "dating": 1.0, "deal": 0.5, "deals": 0.5, "diet": 0.5, "discount": 0.5, "download": 0.5,
    "earn": 0.5, "erotic": 1.5, "fast-cash": 1.5, "free": 0.5, "free-bets": 1.5, "gamble": 1.5, "gambling": 1.5, "giveaway": 1.0, "hack": 1.0, "hot": 0.5, "jackpot": 1.5, "limited-offer": 1.0, "loan": 1.0, "loans": 1.0,
    "lottery": 1.5, "lotto": 1.5, "lucky": 0.5, "make-money": 1.5, "meds": 1.0, "miracle": 0.5, "money": 0.5, "mp3": 0.5, "nude": 1.5, "offer": 0.5, "offers": 0.5, "online-pharmacy": 1.5, "pharmacy": 1.0, "pills": 1.5,
    "poker": 1.5, "popup": 1.0, "prize": 1.0, "prizes": 1.0, "promo": 0.5, "proxy": 0.5, "replica": 1.0, "rolex": 1.0, "sale": 0.5, "serial": 0.5, "sex": 1.5, "sexy": 1.5, "singles": 1.0, "slots": 1.5, "steroids": 1.5,
    "streaming": 0.5, "tracker": 0.5, "torrent": 1.0, "torrents": 1.0, "unblocked": 1.0, "weight-loss": 1.0, "win": 0.5, "winner": 1.0, "winners": 1.0,
}
SOFT_LIMIT = 2.0


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host, and path, of a url."""
    rest = (url or "").partition("://")[2]
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return ascii_lower(host), slash + path


def fitting_rule(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule that fits; of equally long ones the first by verdict and name."""
    best, suffix = None, host
    while True:
        for rule in by_host.get(suffix, ()):
            if path.startswith(rule.path) and (best is None or (-len(rule.name), rule.verdict, rule.name) < (-len(best.name), best.verdict, best.name)):
                best = rule
        _, dot, suffix = suffix.partition(".")
        if not dot:
            return best


@lru_cache(4)
def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight))
    for term in strict:
        found.add_word(term, (term, None))
    found.make_automaton()
    return found


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(url: str | None, terms: ahocorasick.Automaton) -> dict[str, float | None]:
    """The distinct terms between boundaries; a strict one has no weight."""
    text, hits = ascii_lower(url or ""), {}
    for end, (term, weight) in terms.iter(text):
        start = end + 1 - len(term)
        if not (start and _inside(text[start - 1])) and not (end + 1 < len(text) and _inside(text[end + 1])):
            hits[term] = weight
    return hits


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = (),
    strict: tuple[str, ...] = STRICT, soft: dict[str, float] = SOFT, soft_limit: float = SOFT_LIMIT,
) -> DataFrame:
    """id, url, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of every row: one map, no shuffle."""
    weights = tuple(sorted(soft.items()))

    def make():
        terms, by_host = automaton(strict, weights), {}
        for rule in rules:
            by_host.setdefault(rule.host, []).append(rule)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            urls, rows = batch.column(1).to_pylist(), []
            for url in urls:
                host, path = split_url(url)
                rule, hits = fitting_rule(host, path, by_host), term_hits(url, terms)
                bad, mild = sorted(t for t, w in hits.items() if w is None), sorted(t for t, w in hits.items() if w is not None)
                weight = sum(hits[t] for t in mild)
                verdict = rule.verdict if rule else "block" if bad or weight >= soft_limit else "allow"
                rows.append((host, path, rule and rule.name, verdict, bad, mild, float(weight)))
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

        return each

    names = ["id", "url", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"]
    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    return map_batches(picked, make, "id long, url string, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>, soft_weight double")
