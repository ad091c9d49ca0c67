"""URL filter: host rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions only.  The model has ``BUCKETS`` weights; it is fitted on the driver to the n-gram counts of the
table below (under 200 urls, each labelled by hand, so what the driver gathers is bounded), and reaches the rows as one
literal array.  All digits count as the same, so numbers in a path don't sway it.  Without evidence a url is allowed.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import lower_ascii

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

BUCKETS = 16384
GRAMS = (2, 3, 4)
#: What the n-grams of the host and of the path count for, each set as a whole.
PART_WEIGHTS = (1.0, 0.5)
EPOCHS = 40
RATE = 0.3
DECAY = 2e-4
#: Parts of the table, in the order of the urls' hashes, of which one can be held out.
FOLDS = 5

#: Urls of sites that a text corpus doesn't want: gambling, pills, adult, piracy, scams, link farms, doorway pages.
BLOCKED = """
http://cheap-meds-online.com/about
https://www.discount-pills4u.net/shop/cart?id=9
http://buy-viagra-now.info/
https://cheapest-cialis.biz/order.html
http://rx-pharmacy-express.org/en/12
https://generic-pills-store.co.uk/en/33.html
http://weightloss-pills-miracle.com/landing/1
https://www.royal-casino-online.com/bonus/welcome
http://casino-jackpot-party.net/news/3
https://m.bestcasinos4you.info/slots
http://online-casino-win.org/en/18
https://vegas-casino-club.de/spiele/bonus
http://casino-en-ligne-gratuit.fr/jeux
https://pokerstarz-freeroll.com/play
http://poker-bonus-code.net/2019/05/story.html
https://www.texas-poker-cash.biz/tables
http://bingo-and-slots.co/lobby
https://free-bets-today.com/odds/football
http://sports-betting-tips.info/bet/now
https://www.bet-365-mirror.net/login
http://bets-and-odds-win.org/free-bet
https://m.live-bets.example.net/en/51
http://apuestas-gratis-bono.es/registro
https://sportwetten-bonus-gratis.de/wetten
http://lottery-winner-claim.com/prize/claim.php
https://xxx-videos-free.com/watch/4821
http://www.hot-adult-dating.net/profiles/near-you
https://www.adult-cams-live.org/de/22.html
http://adult-friends.example.com/fr/8
https://free-porn-tube.biz/category/new
http://pornhd-streams.net/video/77812
https://sexy-girls-chat.com/live
http://sex-shop-videos.co/adult/toys
https://m.nude-pics-daily.com/gallery/3
http://erotic-stories-xxx.org/article/99
https://milf-webcam-adult.net/
http://escorts-in-city.com/girls
https://warez-full-download.com/crack/keygen
http://cracked-software-free.net/serial/photoshop
https://torrent-movies-hd.org/download/1080p
http://keygen-serials.biz/get/office-crack
https://free-movies-stream-hd.co/watch-online-free
http://mp3-download-gratis.info/song/123
https://nulled-scripts-warez.net/wordpress/theme
http://apk-mod-unlimited-gems.com/hack/coins
https://game-hack-generator.net/free-gold
http://earn-money-fast-home.com/join/affiliate
https://www.make-cash-online.biz/work-from-home
http://get-rich-quick-system.info/secret
https://payday-loans-instant.com/blog/7
http://fast-cash-loan-approval.net/apply-now
https://bad-credit-loans-usa.org/quick-loan
http://cheap-car-insurance-quotes.info/compare/cheap
https://bitcoin-doubler-profit.com/invest/now
http://crypto-profit-robot.net/signup?aff=31
https://forex-signals-millionaire.biz/vip
http://binary-options-profit.co/register
https://free-iphone-winner.com/claim/prize
http://you-won-gift-card.net/survey/claim.php?u=1
https://survey-reward-free.info/win/voucher
http://secure-login-verify-account.com/update/password
https://account-suspended-verify.net/signin/confirm
http://bank-login-update-secure.info/verify.php
https://seo-backlinks-cheap.com/buy/links
http://link-farm-directory.net/submit/seo
https://buy-traffic-cheap.biz/seo/packages
http://spam-links-exchange.org/es/4
https://article-spinner-seo.com/spin
http://guest-post-links-buy.info/price
https://best-seo-links.net/backlinks/1000
http://clickbait-news-viral.com/you-wont-believe/7
https://viral-shock-video.net/click/here
http://celebrity-nude-leak.co/click
https://doorway-cheap-shoes.com/outlet/sale/discount
http://replica-watches-cheap.net/rolex/buy
https://fake-designer-bags-outlet.com/sale
http://cheap-nike-outlet-store.biz/buy/discount
https://discount-ray-ban-sale.info/outlet
http://ad-click-tracker.com/ad/click?id=55
https://popunder-ads-network.net/banner/click
http://ads.trackserve-banner.com/redirect?url=x
https://click.promo-offers-win.com/win/bonus
http://toolbar-free-download.info/install.exe
https://driver-update-fix-pc.com/download/setup.exe
http://pc-cleaner-free-scan.net/install
https://horoscope-love-spell.biz/order/psychic
http://hair-loss-miracle-cure.com/buy/now
https://penis-enlarge-pills.org/order
http://diet-miracle-detox.net/buy/cheap
https://essay-writing-cheap.com/buy-essay/order
http://buy-followers-cheap.net/instagram/likes
https://free-followers-hack.info/get
http://spamfarm-pages.com/page/1
https://casino-spam.example.org/en/60
""".split()

#: Ordinary sites.
ALLOWED = """
https://github.com/apache/spark
https://en.wikipedia.org/wiki/Suffix_automaton
https://de.wikipedia.org/wiki/Haus
https://fr.wikipedia.org/wiki/Lyon
https://www.bbc.co.uk/news/science-environment-51234567
https://www.nytimes.com/2020/05/11/world/europe/story.html
https://docs.python.org/3/library/functools.html
https://stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster
https://arxiv.org/abs/1706.03762
https://www.nature.com/articles/s41586-019-1666-5
https://university.edu/physics
http://www.physics.university.edu/courses/quantum/notes.html
https://library.state.edu/catalog/record/99123
https://museum.city.org/exhibitions/roman-glass
http://town-council.gov.uk/planning/applications/2019
https://www.gov.uk/guidance/register-a-birth
https://weather.service.gov/forecast/42
https://data.census.gov/tables/2010
https://www.who.int/health-topics/malaria
https://europa.eu/legislation/summary
https://www.loc.gov/item/2004667089
http://blog.smalltown-bakery.com/2018/04/sourdough-starter
https://blog.gardening-notes.net/tomatoes/pruning
http://www.birdwatchers.org/sightings/march
https://myblog.example.com/en/123
https://www.local-newspaper.com/sports/high-school/scores
http://news.village.net/article/4512
https://magazine.travel-stories.com/norway/fjords
https://recipes.grandma-kitchen.com/soup/lentil
https://www.cooking-at-home.net/recipes/bread.html
http://hiking-trails.org/region/alps/day-7
https://cycling-club.de/touren/2017
https://www.stadtbibliothek.de/de/veranstaltungen/678.html
http://www.schule-am-park.de/klassen/5b
https://verein-der-gartenfreunde.de/satzung
https://www.rathaus-neustadt.de/buergerservice
https://lemonde-des-livres.fr/critiques/roman
http://www.mairie-ville.fr/culture/agenda
https://cuisine-de-saison.fr/recettes/tarte
https://www.lycee-victor.fr/eleves/emploi-du-temps
https://www.ayuntamiento-pueblo.es/noticias/2016
http://biblioteca-publica.es/es/catalogo/9
https://revista-de-historia.es/articulos/edad-media
https://cocina-casera.es/recetas/paella
http://www.universidad.es/facultad/medicina
https://forum.linux-users.org/thread/8812
https://community.photographers.net/topic/lens-cleaning
http://mailing-list.archive.org/msg/00231.html
https://wiki.chess-players.org/openings/sicilian
https://www.mathforum.org/library/topics/geometry
https://open-textbooks.org/biology/chapter-3
http://www.poetry-archive.net/poems/autumn
https://gutenberg.org/files/1342/1342-h/1342-h.htm
https://archive.org/details/gullivers-travels
https://journal.medicine.org/content/12/3/245
https://www.hospital-central.org/departments/cardiology
http://dentist-mainstreet.com/about
https://law-office-miller.com/attorneys/team
https://www.accounting-firm.net/services
http://plumber-brothers.com/contact
https://carpenter-workshop.com/gallery/tables
https://architects-studio.net/projects/school
https://www.orchestra-city.org/concerts/2015/season
http://theatre-company.org/plays/hamlet
https://film-festival.org/programme/2014
https://www.railway-timetable.com/stations/north
http://airport-info.net/departures
https://bookshop-corner.com/authors/a
https://www.toy-museum.org/collection/trains
http://astronomy-club.org/observing/moon
https://geology.rocks.org/minerals/quartz
https://www.animal-shelter.org/adopt/dogs
http://farmers-market.net/vendors/list
https://wine-growers.com/region/valley/history
https://tech-company.com/blog/2021/release-notes
https://developer.platform.com/docs/api/reference
http://opensource-project.org/download/source.html
https://packages.linux.org/main/gcc
https://www.kernel.org/doc/html/latest/process
https://maps.city.net/streets/12
http://history-society.org/archives/letters/1861
https://genealogy.families.net/tree/smith
https://www.language-school.com/courses/spanish/beginner
https://kids-learning.org/maths/fractions
http://school-district.k12.us/calendar
https://charity-water.org/projects/wells
https://www.church-parish.org/services
http://football-club.net/fixtures/2018
https://www.running-results.com/marathon/2013/results
https://tennis.club.org/members/ladder
http://m.daily-post.com/opinion/745
https://www.radio-station.fm/shows/morning
https://podcast.makers.net/episode/31
http://www.old-maps.org/europe/1750.html
https://shop.craft-supplies.com/wool/blue
https://store.music-instruments.net/guitars/acoustic
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The training table: (url, 1 for block or 0 for allow)."""
    return [(url, 1) for url in BLOCKED] + [(url, 0) for url in ALLOWED]


def held_out_split(rows: list[tuple[str, int]], fold: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(rows to learn from, rows held out), parted by the order of hashes."""
    ordered = sorted(rows, key=lambda r: (hash_order(r[0]), r[0]))
    return [r for k, r in enumerate(ordered) if k % FOLDS != fold], ordered[fold::FOLDS]


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column) -> Column:
    """Buckets of all character n-grams of the text between two marks, digits as 0; a text shorter than n gives none."""
    marked = F.concat(F.lit("^"), F.translate(text, "123456789", "0" * 9), F.lit("$"))

    def of(n: int) -> Column:
        size = F.length(marked) - n + 1
        starts = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(marked, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(of(n) for n in GRAMS))


def features(host: Column, path: Column) -> tuple[Column, Column]:
    """Hashed n-grams of host and path; the path's carry a mark so that they don't mix with the host's.

    A host's first label www or m says nothing and is left out.
    """
    return _grams(F.regexp_replace(host, "^(www|m)[.]", "")), _grams(F.concat(F.lit("\u0001"), path))


def fit(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> list[float]:
    """BUCKETS weights and the intercept, by stochastic gradient steps in a fixed order."""
    table = spark.createDataFrame(rows or labelled_urls(), "url string, label int")
    parts = features(url_host(F.col("url")), url_path(F.col("url")))
    grams = table.select("url", "label", F.array(*parts).alias("parts")).collect()
    data = []
    for r in sorted(grams, key=lambda r: (hash_order(r["url"]), r["url"])):
        counts: dict[int, float] = defaultdict(float)
        for part, weight in zip(r["parts"], PART_WEIGHTS):
            for g in part:
                counts[g] += weight / math.sqrt(len(part))
        data.append((counts, r["label"]))
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(EPOCHS):
        for counts, label in data:
            z = b + sum(w[g] * v for g, v in counts.items())
            step = RATE * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for g, v in counts.items():
                w[g] += step * v - RATE * DECAY * w[g]
            b += 0.1 * step
    return [round(x, 6) for x in w] + [round(b, 6)]


def hash_order(url: str) -> int:
    """A fixed shuffle of the training rows."""
    out = 2166136261
    for byte in url.encode():
        out = (out ^ byte) * 16777619 % 2**32
    return out


def block_probability(host: Column, path: Column, weights: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")  # one literal once folded, not one a weight
    z = F.lit(weights[-1])
    for grams, weight in zip(features(host, path), PART_WEIGHTS):
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
        z = z + F.lit(weight) * total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-z))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the start of the path: (rule, verdict), else nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, site, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        name, verdict = F.when(fits, site + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (the model's probability of block).

    A null url, or one without ``://``, has an empty host and path and is judged by the model on those.
    Repeated rows are judged alike, each on its own; other columns are ignored.  An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("score", block_probability(F.col("host"), F.col("path"), weights))
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, model).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit(spark))


#: The hashed model has no SQL form; the query is tested against brute force.
SQL = None
