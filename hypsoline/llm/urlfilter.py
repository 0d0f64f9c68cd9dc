"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import col, map_arrow

BUCKETS = 1 << 13
GRAMS = (3, 4, 5)
#: The longest host or path whose n-grams are held at once; longer ones are added up in parts that overlap.
PART = 1 << 16

#: The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table: urls, without their scheme, of pages that a crawl keeps and of pages that it drops (gambling,
#: adult, pills, loans, pirated software, malware, link farms, advertising). Names are invented or generic.
KEEP = """
en.wikipedia.org/wiki/Photosynthesis
de.wikibooks.org/wiki/Mathe_für_Anfänger
docs.python.org/3/library/asyncio.html
developer.mozilla.org/en-US/docs/Web/HTTP/Status
www.gutenberg.org/files/1342/1342-h/1342-h.htm
arxiv.org/abs/1706.03762
pubmed.ncbi.nlm.nih.gov/31978945/
www.nasa.gov/missions/webb/galaxies
www.bbc.co.uk/news/science-environment-51234567
www.lemonde.fr/planete/article/2020/01/05/climat.html
www.spiegel.de/wissenschaft/natur/a-1234.html
elpais.com/cultura/2021-03-02/una-exposicion.html
city-library.example.org/catalogue/search
museum-of-glass.example.com/visit/opening-hours
www.stmarys-school.example.org/parents/calendar
riverside-council.example.org/planning/applications/2231
weather-station.example.net/forecast/weekly
gardening-notes.example.com/roses/pruning-in-winter
grandmas-kitchen.example.com/recipes/lentil-soup
railway-history.example.org/stations/closed
mountain-hikes.example.net/trails/north-ridge
physics-lectures.example.edu/mechanics/chapter-4.pdf
orchestra.example.org/concerts/spring-season
harbour-news.example.com/local/fishing-fleet
poetry-review.example.org/issues/34/contents
community-forum.example.net/t/how-to-fix-a-bicycle/4411
open-data.example.gov/datasets/water-quality
astronomy-club.example.org/events/meteor-shower
translation-memory.example.com/guide/getting-started
linguistics.example.edu/faculty/papers/2019/phonology
village-bakery.example.com/bread/rye
theatre-royal.example.org/whats-on/hamlet
birdwatching.example.net/species/robin
chess-problems.example.com/endgames/rook
knitting-patterns.example.com/scarves/simple
archive.example.org/details/letters-1911
university-press.example.edu/books/history-of-trade
patients-guide.example.org/conditions/asthma
small-farm-diary.example.com/2018/06/hay
embassy.example.gov/visa/students
cycling-maps.example.net/routes/coast
public-radio.example.org/programmes/evening-concert
software-manuals.example.com/editor/shortcuts
statistics-office.example.gov/tables/population
marine-biology.example.edu/research/corals
choir.example.org/rehearsals
football-results.example.com/league/table
photography-tips.example.net/lenses/macro
philosophy-notes.example.com/kant/critique
vegetarian-cooking.example.org/starters
local-history.example.net/mills/water-wheel
language-exchange.example.com/en/meetings
blog.example.com/2020/11/a-week-in-lisbon
m.example.net/de/artikel/83521
www.example.org/fr/pages/accueil.html
example.com/es/noticias/2312
lectures.example.edu/algebra/groups?week=3
parliament.example.gov/debates/2017/11/08
wood-workshop.example.com/joints/dovetail
clinic.example.org/staff
island-ferries.example.com/timetable/summer
rare-books.example.net/catalogue/atlas
mathematics.example.edu/~smith/notes.ps
newsletter.example.org/issue/12
beekeeping.example.com/hives/spring
court-records.example.gov/judgments/2015/77
old-maps.example.org/sheets/north
soil-science.example.edu/courses
symphony-notes.example.com/mahler/5
children-stories.example.net/the-fox
power-grid.example.com/outages
botany.example.org/herbarium/ferns
train-times.example.net/departures
harvest-festival.example.org/programme
www.town-hall.example.org/en/services
bridge-engineering.example.com/spans
coffee-roasters.example.com/origins
open-source.example.org/projects/parser
insurance-law.example.edu/cases
water-colours.example.net/gallery
"""
DROP = """
best-casino-bonus.example.com/slots/free-spins
lucky-poker-room.example.net/join?aff=8812
mega-jackpot.example.org/play-now
online-betting-tips.example.com/odds/today
free-slots-win.example.net/register-bonus
roulette-king.example.com/deposit/bonus-200
super-lotto-winner.example.net/claim
sports-bets.example.org/live-odds
casino.example.com/vip/free-chips
win-cash-now.example.net/lottery/prize
xxx-videos.example.com/watch/hot
adult-cams.example.net/live/girls
hot-singles.example.com/near-you
sexy-dating.example.org/join-free
porn-tube.example.net/categories
escort-girls.example.com/city
nude-webcam.example.net/chat
milf-clips.example.com/free
cheap-viagra-pills.example.com/order-now
online-pharmacy.example.net/no-prescription
buy-cialis.example.org/discount
weight-loss-pills.example.com/miracle
discount-meds.example.net/buy/xanax
canadian-pharma.example.com/cheap/tramadol
hair-growth-miracle.example.org/offer
payday-loans.example.com/instant-approval
fast-cash-loan.example.net/apply
bad-credit-loans.example.org/guaranteed
get-rich-quick.example.com/secret
forex-profits.example.net/signals/vip
bitcoin-doubler.example.org/invest
crypto-giveaway.example.com/claim-free-coins
earn-money-fast.example.net/from-home
replica-watches.example.com/rolex-cheap
fake-designer-bags.example.net/sale
cracked-software.example.com/keygen/download
warez-zone.example.net/serials
free-movie-torrents.example.org/download-hd
keygen-crack.example.com/patch.exe
nulled-scripts.example.net/premium-free
pirate-streams.example.org/watch-free
download-codec-update.example.com/setup.exe
your-computer-infected.example.net/alert
virus-scan-alert.example.org/download/cleaner.exe
account-verify-login.example.com/secure/update
paypa1-secure-login.example.net/confirm
bank-verification.example.org/signin/confirm.php
free-gift-cards.example.com/survey
claim-your-prize.example.net/winner
iphone-giveaway.example.org/survey/step1
click-here-win.example.com/offer
popup-ads.example.net/click?zone=44
ad-server.example.com/banner/track.js
ads-tracker.example.net/pixel.gif
clicktrack.example.org/redirect?url=
banner-exchange.example.com/ads/show
affiliate-offers.example.net/redirect/aff
link-farm.example.com/links/page37
buy-backlinks.example.net/seo/cheap
seo-link-directory.example.org/submit
article-spinner.example.com/spam
spam-mailer.example.net/bulk
doorway-pages.example.org/cheap-insurance-quotes
bulk-followers.example.com/buy-likes
free-ringtones.example.net/subscribe
psychic-reading.example.com/free-call
penny-auction.example.org/bid-now
hotgirls.example.com/pics
bet-and-win.example.net/sports/bonus-code
casinowin.example.org/free-bet
adultfriend.example.com/hookup
pillstore.example.net/cheap
xxxcams.example.org/live
torrentking.example.com/top
freecracks.example.net/activation-key
quickpayday.example.org/loan
spamlinks.example.com/farm
adtrack.example.net/click
winprizes.example.org/lucky
slotsbonus.example.com/spin
"""
#: Invented names, of a rule, that say nothing and are kept, on hosts like those above.
INVENTED = 480
LETTERS = ("bcdfghjklmnprstvwz", "aeiou")
ENDINGS = ("example.com", "example.org", "example.net", "example.edu", "test")
PATHS = ("/", "/{}", "/en/{}.html", "/de/{}/", "/page/{}?id=2", "/index.html", "/articles/{}", "")


def table() -> list[tuple[str, str, int]]:
    """(host, path, label) rows of the labelled table, without queries."""
    rows = []
    for listed, y in ((KEEP, 0), (DROP, 1)):
        for url in listed.split():
            host, slash, rest = url.partition("/")
            rows.append((host, (slash + rest).split("?")[0], y))
    return rows


def widened(rows: list[tuple[str, str, int]], invented: int = INVENTED) -> list[tuple[str, str, int]]:
    """rows, and rows made by rule: each word of four letters or more in the hosts of one label only, beside invented names
    in three ways, and kept rows of invented names alone."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice(LETTERS[i % 2]) for i in range(rng.randint(4, 11)))
    place = lambda x: (f"{rng.choice(('', 'www.', 'm.', 'blog.'))}{x}.{rng.choice(ENDINGS)}", rng.choice(PATHS).format(rng.randrange(9999)))
    words: dict[str, set[int]] = {}
    for host, _, y in rows:
        for w in re.findall("[a-z]{4,}", host.replace("example", "")):
            words.setdefault(w, set()).add(y)
    out = list(rows)
    for w in sorted(words):
        if len(words[w]) == 1:
            out += [(*place(x), min(words[w])) for x in (f"{w}-{name()}", f"{name()}-{w}", f"{w}{name()}")]
    return out + [(*place(name()), 0) for _ in range(invented)]


@functools.lru_cache(maxsize=1)
def labelled() -> tuple[tuple[str, str, int], ...]:
    return tuple(widened(table()))


def grams(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, L2-scaled counts) of the hashed n-grams of ^host$, which count twice, and ^path$, kept apart by a tag."""
    parts = []
    for tag, value, weight in ((b"h", host, 2.0), (b"p", path, 1.0)):
        data = b"^" + value.encode("utf-8", "replace") + b"$"
        for at in range(0, len(data), PART):  # parts overlap, so that no n-gram is lost
            some = [zlib.crc32(tag + data[i : i + n]) % BUCKETS for n in GRAMS for i in range(at, min(at + PART, len(data) - n + 1))]
            found, counts = np.unique(np.array(some, np.int64), return_counts=True)
            parts.append((found, counts * weight))
    if len(parts) == 2:  # tags may meet in a bucket
        found, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(found))
    else:
        counts = sum(np.bincount(f, c, minlength=BUCKETS) for f, c in parts)
        found = np.flatnonzero(counts)
        counts = counts[found]
    return found, counts / max(1.0, np.sqrt(counts @ counts))


def features(host: str, path: str) -> np.ndarray:
    """The same as a dense vector, for training."""
    out = np.zeros(BUCKETS)
    found, counts = grams(host, path)
    out[found] = counts
    return out


def score(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    """The probability that a page is to be dropped."""
    found, counts = grams(host, path)
    return 1 / (1 + np.exp(-(float(counts @ weights[found]) + bias)))


def train(rows, rounds: int = 1000, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent from zero: the same weights on every run. Weights stay sums of the rows' features,
    so the steps are taken on the factors of the rows."""
    x, y = np.array([features(h, p) for h, p, _ in rows]), np.array([y for _, _, y in rows], dtype=float)
    gram, a, b = x @ x.T, np.zeros(len(y)), 0.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(gram @ a + b))) - y
        a -= rate * (gap / len(y) + decay * a)
        b -= rate * gap.mean()
    return x.T @ a, b


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host/path) whose host is the url's or a parent of it and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, rule).otherwise(out)
    return out


def judge(pages: DataFrame, url: str = "url", rules=RULES, rows=None, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score double and verdict to pages; input columns of these names are replaced.

    `rules` is a list of the configuration (held in the plan, so hundreds at most); `rows` the labelled
    (host, path, 0 or 1) table, the small built-in one by default. A fitting rule decides; else the method blocks
    at a score of `threshold` or more. Null or malformed urls have an empty host and path, are scored as such and
    fit no rule. Rows are judged one by one, so repeated rows agree; very long urls are read whole.
    """
    weights, bias = train(tuple(rows) if rows is not None else labelled())
    names = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in names]

    def make(rows_: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        found = [score(x, y, weights, bias) for x, y in zip(*[a.to_pylist() for a in arrays], strict=True)]
        yield rows_, [*arrays, pa.array(found, pa.float64())]

    outputs = [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]
    scored = map_arrow(pages, kept, [host_of(col(url)), path_of(col(url))], outputs, make)
    verdicts = F.lit(None).cast("string")
    for r, v in rules:
        verdicts = F.when(F.col("rule") == r, v).otherwise(verdicts)
    out = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.withColumn("verdict", F.coalesce(verdicts, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op4(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
