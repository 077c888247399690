"""URL filter: rules by host and path, then a weighted vocabulary.

Terms are found in one Aho-Corasick pass over the lowered url and count only between
characters other than letters and digits. One strict term rejects; soft terms reject
when several distinct ones are met.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed by the contract: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
STRICT = ("porn", "xxx", "hentai", "escort", "escorts", "casino", "warez", "malware", "phishing", "viagra", "adult-x")
SOFT = ("ads", "ad", "adult", "track", "tracker", "tracking", "click", "clicks", "popup", "banner", "banners", "promo", "affiliate", "sponsor",
        "sponsored", "utm_source", "referral", "redirect", "coupon", "bet", "betting", "dating", "torrent", "proxy", "sex")
MIN_SOFT = 2


@cache
def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]):
    terms = ahocorasick.Automaton()
    for term in soft:
        terms.add_word(term, (term, False))
    for term in strict:
        terms.add_word(term, (term, True))
    terms.make_automaton()
    return terms


def _inside(ch: str) -> bool:
    return "a" <= ch <= "z" or "0" <= ch <= "9"


def term_hits(url: str, strict=STRICT, soft=SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the url with a boundary on either side."""
    met = set()
    for end, (term, hard) in vocabulary(strict, soft).iter(url):
        start = end + 1 - len(term)
        if (start == 0 or not _inside(url[start - 1])) and (end + 1 == len(url) or not _inside(url[end + 1])):
            met.add((term, hard))
    return sum(hard for _, hard in met), sum(not hard for _, hard in met)


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lowered, and path; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return _lower(rest[:end]), path[:stop]


def matching_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, the first one among equally long ones."""
    best = None
    for verdict, of, start in rules:
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(of + start) > len(best[0])):
            best = (of + start, verdict)
    return best


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) of every row of `pages`.

    A null url, or one without `://`, has an empty host and path, no rule and, without terms,
    is allowed. Each row is judged alone; other columns are not read.
    """
    strict, soft, rules = tuple(strict), tuple(soft), tuple(rules)

    def judge(batches):
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = matching_rule(host, path, rules) or (None, None)
                hard, light = term_hits(_lower(url or ""), strict, soft)
                rows.append((host, path, rule, verdict or ("block" if hard or light >= min_soft else "allow"), hard, light))
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                             ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")
