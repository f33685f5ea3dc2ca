"""URL filter, by DataFrame functions only: rules first, a logistic model for the rest.

The model is a logistic regression over hashed character trigrams of host and
path. It is fitted on the driver from the constant table HOSTS below, and its
weights, rounded to millionths, are one string literal in the
plan that folds into an array of 4,096 integers, so scoring is a projection without any shuffle and sums are exact.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import LOWER, UPPER, read

BUCKETS = 4096
SCALE = 1_000_000
#: (verdict, host, path). A path must be a prefix of the url's path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: The small labelled table, made for this filter: hosts of each verdict, by what they are about. 1: unwanted.
HOSTS = {
    1: """luckyspin-casino.test royal-casino-club.test casinobonus24.test online-casino.test pokerroom-bonus.test slots-jackpot.test megajackpot-slots.test
       roulette-wins.test betting-tips.test sportsbet-bonus.test bet-now.test freebet-offers.test bets24.test livebets.test win-big-prizes.test winner-prize.test
       discount-pharmacy.test pharmacy-pills.test pillstore.test cheap-meds.test cheap-viagra.test generic-cialis-pills.test diet-pills-offer.test cheapest-drugs.test
       adult-cams.test adultdating.test xxx-videos.test free-xxx.test sexchat-live.test hot-sex.test porn-tube.test pornhd-free.test nude-escorts.test adult-toys-x.test
       spammer-tools.test bulk-spam.test spam-mailer.test email-spam-lists.test backlink-farm.test linkfarm.test link-farm-seo.test seo-backlinks.test buy-traffic-links.test farm-of-links.test
       ad-server.test adserver-banner.test ads-network.test popup-ads.test ads.banner-clicks.test click-tracker.test track-clicks.test tracking-pixel.test adtracking.test pixel-tracker-ads.test
       payday-loans.test instant-loan-cash.test cash-loans-fast.test quick-cash.test crypto-doubler.test double-bitcoin.test free-bitcoin-giveaway.test lottery-prize.test prize-lottery-claim.test
       replica-watches.test replica-handbags-cheap.test cheap-replica.test work-from-home-cash.test get-rich-fast.test free-gift-cards.test freeprizes.test free-iphone-winner.test
       sexy-singles.test sexdating.test personal-loans-cash.test loan-today.test loans4u.test spam-hosting.test spambot.test banner-ads.test mobile-ads-server.test adclicks.test
       onlinepharmacy-meds.test pills-discount.test casino-games-free.test vegas-slots.test bets-and-odds.test adult-xxx.test cheap-followers.test buy-backlinks.test cashprize.test bitcoin-casino.test""",
    0: """city-library.test libraryofletters.test gardening-notes.test thegarden.test mathematics-department.test institute-of-physics.test physicsnotes.test chemistry-lessons.test
       regional-weather.test weatherstation.test river-news.test morning-herald.test theguardianpost.test local-newspaper.test thechronicle.test newsletter-archive.test national-museum.test
       museum-of-art.test arthistory.test medieval-history.test history-society.test cooking-at-home.test bakery-recipes.test thebreadbook.test mountain-hiking.test hikingtrails.test
       cycling-forum.test railway-timetable.test transport-authority.test ministry-of-education.test primary-school.test universitypress.test theuniversity.test student-union.test
       openstandards.test software-documentation.test programming-handbook.test linux-kernel-notes.test databasedesign.test thecompiler.test engineering-journal.test bridge-builders.test
       woodworking.test carpentry-guide.test photography-club.test orchestra.test chamber-music.test theatre-programme.test poetry-reading.test novels-and-essays.test translation-bureau.test
       grammar-lessons.test dictionary-of-words.test ornithology.test birdwatching.test marine-biology.test thenatureguide.test astronomy-observatory.test stargazers.test geology-maps.test
       health-service.test hospital-information.test nursing-training.test childcare-advice.test thefamilydoctor.test farmers-market.test village-council.test parish-records.test
       electionresults.test parliament-minutes.test court-decisions.test statistics-office.test census-tables.test international-relations.test tradeunion.test chess-club.test
       tests-and-measurements.test postal-addresses.test vestry.test harvest-festival.test masters-athletics.test distances.test stonemason.test openwater-swimming.test hathaway-cottage.test
       thethatchers.test northern-lights.test another-thought.test wetlands.test beadwork.test adsorption-lab.test roads-and-bridges.test threads-and-knitting.test alphabets.test betting-history-archive.test
       linklater-family.test farmhouse-holidays.test winter-sports.test windmills.test pilgrim-paths.test slotted-screws.test trackways.test cinematheque.test sexton-records.test""",
}
PATHS = ("", "/", "/en/728", "/page/3.html", "/fr/17/", "/de/5081")


def labelled() -> list[tuple[str, str, int, bool]]:
    """Host, path, verdict and whether the host is every fifth of its verdict, as a held-out part for measuring."""
    return [(f"{sub}{h}", p, y, k % 5 == 4) for y, hosts in HOSTS.items() for k, h in enumerate(hosts.split()) for sub, p in zip(("", "www.", "", "m.", "blog.", ""), PATHS)]


def _buckets(text: str) -> list[int]:
    c = [ord(x) for x in text]
    return [(c[i] * 961 + c[i + 1] * 31 + c[i + 2] * 7 + c[i] * c[i + 2]) % BUCKETS for i in range(len(c) - 2)]


@lru_cache(2)
def weights(held_out: bool = False) -> tuple[int, tuple[int, ...]]:
    """Bias and one weight a bucket, in millionths; with held_out the held-out hosts are not learned from.

    Full-batch descent with a small ridge, by plain sums, so it is the same on every machine.
    """
    rows = [(_buckets(f"^{h}{p}$"), y) for h, p, y, held in labelled() if not (held_out and held)]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(60):
        grad: dict[int, float] = {}
        gb = 0.0
        for x, y in rows:
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum([w[i] for i in x]))))) - y
            gb += g
            for i in x:
                grad[i] = grad.get(i, 0.0) + g
        b -= 0.2 * gb / len(rows)
        for i, g in grad.items():
            w[i] -= 4.0 * g / len(rows) + 1e-4 * w[i]
    return round(b * SCALE), tuple(round(x * SCALE) for x in w)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones come to stand outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """All columns of pages with host, path, rule, score and verdict.

    Null urls and urls without '://' have an empty host and path and are judged by
    the model as such. Ties between rules of one length go to the later name.
    Columns of pages that bear the name of a result are replaced. Rows never go.
    """
    names = ("host", "path", "rule", "score", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    parts = pages.select(*kept, host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", name.alias("rule"), verdict.alias("__cq_verdict"))
    # codes are looked up several times for each gram: an array column of its own is made once
    codes = F.transform(F.split(F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    scored = scored.withColumn("__cq_codes", codes)
    b, w = weights()
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<long>")
    c = F.col("__cq_codes")
    grams = F.zip_with(F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                       F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))), lambda p, z: (p["x"] * 961 + p["y"] * 31 + z * 7 + p["x"] * z) % BUCKETS)
    score = F.aggregate(grams, F.lit(b).cast("long"), lambda a, g: a + F.get(table, g.cast("int")))
    scored = scored.withColumn("score", score)
    return scored.select(*[f"`{x.strip('`')}`" for x in (y for y in pages.columns if y not in names)], "host", "path", "rule", "score",
                         F.coalesce("__cq_verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    b, w = weights()
    up, low = UPPER, LOWER
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{up}', '{low}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages
), c AS (
  SELECT *, list_transform(string_split('^' || host || path || '$', ''), lambda x: unicode(x)::BIGINT) AS c FROM u
), s AS (
  SELECT *, {b} + coalesce(list_sum(list_transform(range(1, len(c) - 1), lambda i:
    ([{", ".join(map(str, w))}])[((c[i] * 961 + c[i + 1] * 31 + c[i + 2] * 7 + c[i] * c[i + 2]) % {BUCKETS}) + 1])), 0) AS score FROM c
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
  WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN score > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
