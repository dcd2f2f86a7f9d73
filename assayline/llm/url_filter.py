"""URL filter: domain rules first, then a weighted vocabulary found with an Aho-Corasick automaton.

A rule names a host and the beginning of a path, as ``example.org/en/``; it fits the host and
all its subdomains, and of the rules that fit the longest decides. Host and path of other URLs are
searched for all terms at once (queries and fragments often hold tracking codes and are not). A term counts where no letter or digit of the same kind touches it, so
``bet`` is found in ``free-bet.example`` and not in ``alphabet.example``. One strict term, or
``soft_limit`` different soft terms, block the URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule,
holds no term and is allowed. Each row is judged on its own, repeated rows alike. Extra
columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

STRICT = ("porn", "porno", "xxx", "casino", "casinos", "viagra", "pills", "spam", "bets", "betting", "malware", "phishing", "escort", "hentai")
SOFT = (
    "adult", "ads", "advert", "banner", "bet", "bonus", "cheap", "click", "deal", "deals", "discount", "farm", "free", "gamble", "jackpot",
    "loan", "loans", "lucky", "nude", "pharmacy", "popup", "prize", "promo", "sex", "slots", "track", "tracker", "win", "winner", "x",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    before, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((at for at in map(rest.find, "?#") if at >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.isascii() else host.lower(), path


def find_rule(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule for the host or a parent domain of it whose path begins the path."""
    best, at = None, 0
    while True:
        for rule in rules.get(host[at:], ()):
            if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                best = rule
        at = host.find(".", at) + 1
        if not at:
            return best


def judge(pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
          soft_limit: int = 2) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, strict_hits (occurrences), soft_terms (different ones)."""
    weights = {**{term.lower(): 1 for term in soft}, **{term.lower(): soft_limit for term in strict}}
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()

        def inside(text: str, at: int, side: str) -> bool:
            """The character there continues the term's end: a letter after a letter, a digit after a digit."""
            return 0 <= at < len(text) and (text[at].isalpha() and side.isalpha() or text[at].isdigit() and side.isdigit())

        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = find_rule(host, path, by_host) if host else None
                text, strict_hits, terms = (host + path).lower(), 0, set()
                for end, term in automaton.iter(text) if weights else ():
                    start = end - len(term) + 1
                    if inside(text, start - 1, term[0]) or inside(text, end + 1, term[-1]):
                        continue
                    if weights[term] >= soft_limit:
                        strict_hits += 1
                    else:
                        terms.add(term)
                if rule is None:
                    allowed = not strict_hits and len(terms) < soft_limit
                else:
                    allowed = rule.allow
                row = (host, path, rule.text if rule else None, "allow" if allowed else "block", strict_hits, sorted(terms))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.string()] * 4 + [pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"])

    return pages.select("page_id", "url").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_terms array<string>")
