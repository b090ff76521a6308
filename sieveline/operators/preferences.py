"""Which sites a user goes to for which kind of task, and what to offer there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import classify_task

#: Names of the kinds of tasks; fixed values.
LABELS = {
    "flights": "Flights", "trains": "Trains", "buses": "Buses", "hotels": "Hotels", "cabs": "Cabs", "food": "Food delivery", "groceries": "Groceries", "shopping": "Shopping",
    "movies": "Movies & events", "email": "Email", "calendar": "Calendar", "docs": "Documents", "maps": "Maps", "video": "Video", "music": "Music", "jobs": "Jobs", "social": "Social",
    "stocks": "Investing", "news": "News",
}
#: Sites whose kinds are known, the first the main one; fixed values.
SITES = {
    "makemytrip.com": "flights hotels trains buses", "goibibo.com": "flights hotels buses", "cleartrip.com": "flights hotels", "ixigo.com": "flights trains buses",
    "easemytrip.com": "flights hotels", "yatra.com": "flights hotels", "skyscanner.co.in": "flights", "skyscanner.com": "flights", "goindigo.in": "flights", "airindia.com": "flights",
    "spicejet.com": "flights", "akasaair.com": "flights", "irctc.co.in": "trains", "confirmtkt.com": "trains", "redbus.in": "buses", "abhibus.com": "buses", "booking.com": "hotels",
    "agoda.com": "hotels", "airbnb.co.in": "hotels", "airbnb.com": "hotels", "oyorooms.com": "hotels", "uber.com": "cabs food", "olacabs.com": "cabs", "rapido.bike": "cabs",
    "swiggy.com": "food groceries", "zomato.com": "food", "blinkit.com": "groceries", "zeptonow.com": "groceries", "bigbasket.com": "groceries", "jiomart.com": "groceries shopping",
    "amazon.in": "shopping groceries", "amazon.com": "shopping", "flipkart.com": "shopping groceries", "myntra.com": "shopping", "ajio.com": "shopping", "meesho.com": "shopping",
    "nykaa.com": "shopping", "croma.com": "shopping", "tatacliq.com": "shopping", "bookmyshow.com": "movies", "district.in": "movies", "paytm.com": "movies", "mail.google.com": "email",
    "outlook.live.com": "email", "outlook.office.com": "email", "mail.yahoo.com": "email", "mail.proton.me": "email", "calendar.google.com": "calendar",
    "outlook.office365.com": "calendar email", "docs.google.com": "docs", "notion.so": "docs", "maps.google.com": "maps", "youtube.com": "video", "netflix.com": "video",
    "hotstar.com": "video", "primevideo.com": "video", "jiocinema.com": "video", "open.spotify.com": "music", "music.youtube.com": "music", "music.apple.com": "music", "gaana.com": "music",
    "linkedin.com": "jobs social", "naukri.com": "jobs", "indeed.com": "jobs", "foundit.in": "jobs", "x.com": "social", "twitter.com": "social", "instagram.com": "social",
    "facebook.com": "social", "kite.zerodha.com": "stocks", "zerodha.com": "stocks", "groww.in": "stocks", "upstox.com": "stocks", "moneycontrol.com": "stocks news",
    "timesofindia.indiatimes.com": "news", "thehindu.com": "news", "indianexpress.com": "news", "ndtv.com": "news", "bbc.com": "news",
}
#: Hosts through which a task passes, and the score of a site that the user chose; fixed values.
PASSED = r"(^|\.)(google\.[a-z.]+|bing\.com|duckduckgo\.com|yahoo\.com|search\.brave\.com|localhost)$"
PINNED, KEPT, OFFERED = 1000, 3, 4


#: Version of stored preferences; others are taken for empty.
VERSION = 1


def save_preferences(counts: DataFrame, path: str) -> None:
    """Write a user's counts (or pins) as the new state; readers see the old one until it is whole."""
    counts.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def load_preferences(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; rows of another version are left out."""
    return spark.read.parquet(path).where(F.col("version") == VERSION).drop("version")


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def never_preferred(host: Column) -> Column:
    return (bare_host(host) == "") | bare_host(host).rlike(PASSED)


def host_categories(hosts: DataFrame, host: str) -> DataFrame:
    """``hosts`` with categories: the kinds of the known site that a host is or belongs
    to; the longest known ending decides.  The list of sites is fixed and broadcast."""
    spark: SparkSession = hosts.sparkSession
    known = spark.createDataFrame([(i, s, k.split()) for i, (s, k) in enumerate(SITES.items())], "_i int, _site string, categories array<string>")
    labels = F.split(bare_host(F.col(host)), r"\.")
    # "a.b.c" may be a.b.c, b.c or c
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    one = hosts.select(host).distinct().select(host, F.posexplode(endings).alias("_at", "_site")).join(F.broadcast(known), "_site")
    best = one.groupBy(host).agg(F.min_by("categories", "_at").alias("categories"))
    return hosts.join(best, host, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def site_kind(categories: Column) -> Column:
    """What the open site is for."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.get(categories, F.lit(0)))


def category_scores(counts: DataFrame, pins: DataFrame, user: str) -> DataFrame:
    """(user, category, score) of kinds in use: 3 * tasks + visits over their hosts, and
    1000 for a kind with a chosen site.  ``counts`` has category, host, visits, tasks."""
    used = counts.groupBy(user, "category").agg(F.sum(3 * F.col("tasks") + F.col("visits")).alias("n"))
    chosen = pins.select(user, "category", F.lit(PINNED).alias("p")).distinct()
    score = F.coalesce("n", F.lit(0)) + F.coalesce("p", F.lit(0))
    return used.join(chosen, [user, "category"], "full").select(user, "category", score.cast("long").alias("score")).where("score > 0")


def preferred_sites(counts: DataFrame, pins: DataFrame, user: str, most: int = KEPT) -> DataFrame:
    """(user, category, place, host, pinned, visits, tasks): the chosen site first, whether
    used or not, then by 3 * tasks + visits, then the later use, then the host."""
    keys = [user, "category", "host"]
    rows = counts.select(*keys, "visits", "tasks", "last_us").join(pins.select(*keys, F.lit(True).alias("pinned")), keys, "full").na.fill({"visits": 0, "tasks": 0, "pinned": False})
    rows = rows.where(F.col("pinned") | (F.col("visits") + F.col("tasks") > 0))
    order = Window.partitionBy(user, "category").orderBy(F.desc("pinned"), F.desc(3 * F.col("tasks") + F.col("visits")), F.desc("last_us"), "host")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(user, "category", "place", "host", "pinned", "visits", "tasks")


def preference_hints(tasks: DataFrame, sites: DataFrame, user: str, text: str) -> DataFrame:
    """``tasks`` with hint: where the user usually does such a task; null where the kind is
    unknown, no site is, or the task names one."""
    names_site = F.col(text).rlike(r"(?i)(?<![A-Za-z0-9_])(on|using|via|from|at)\s+[a-z0-9-]+\.(com|in|co\.in|org|net|io)(?![A-Za-z0-9_])|https?://")
    many = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) == 1, "").otherwise("s"))
    why = F.when(F.col("f.pinned"), "the user chose it as their site for this").when(F.col("f.tasks") > 0, F.concat(F.lit("the user has used it for "), many("f.tasks", "earlier task"))).otherwise(F.concat(F.lit("the user has used it "), many("f.visits", "time")))
    per = sites.groupBy(user, "category").agg(F.min_by(F.struct("host", "pinned", "visits", "tasks"), "place").alias("f"), F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "host")))).alias("r"))
    others = F.when(F.size("r") > 0, F.concat(F.lit("; if it cannot, they also use "), F.array_join(F.transform("r", lambda x: x["host"]), " and "), F.lit("."))).otherwise(".")
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    hint = F.concat(F.lit("The user's usual site for "), F.lower(names[F.col("category")]), F.lit(" is "), F.col("f.host"), F.lit(" ("), why, F.lit("). Go there to do this task unless the task names another site"), others)
    joined = tasks.withColumn("category", F.when(~names_site, classify_task(F.col(text)))).join(per, [user, "category"], "left")
    return joined.withColumn("hint", hint).drop("category", "f", "r")


#: What to offer by what a page shows, in order; fixed values.
OFFERS = [
    ("pdf", "Summarise this PDF"), ("cart", "Review my cart"), ("prices >= 6", "List items by price"), ("tables > 0", "Summarise the table"),
    ("fields >= 3 and not login and not payment", "Help me fill this form"), ("article", "Summarise this page"), ("article", "Explain this simply"), ("video", "What is this video about?"),
    ("search", "Search this site"), ("login", "What is this site?"), ("true", "Summarise this page"),
]
#: What to offer on a known site, by its kinds; fixed values.
KIND_OFFERS = {
    "email": ["Summarise my unread emails", "Draft a reply to the latest email", "Find emails with attachments from last week"], "flights": ["Find the cheapest flight", "Compare flights on this page"],
    "trains": ["Find trains between two cities", "Check a PNR status"], "buses": ["Find buses between two cities"], "hotels": ["Find a well-rated hotel", "Compare the hotels on this page"],
    "cabs": ["Check a fare"], "food": ["Reorder my last meal", "Find a well-rated restaurant nearby"], "groceries": ["Add groceries to my cart"],
    "shopping": ["Compare the products on this page", "Find a cheaper alternative"], "movies": ["Find showtimes"], "calendar": ["What's on my calendar this week?", "Find a free slot"],
    "docs": ["Summarise this document"], "video": ["Summarise this video's page"], "jobs": ["Find matching jobs"], "news": ["Summarise the top stories"], "stocks": ["Summarise my portfolio"],
    "maps": ["Get directions"], "music": ["Play something"], "social": ["Summarise my feed"],
}


def suggestions(pages: DataFrame, key: str) -> DataFrame:
    """(key, place, label): up to four offers for each page, each label once: those of the
    site's ``categories``, then those of what the page's profile shows."""
    by_kind = F.create_map(*[x for k, labels in KIND_OFFERS.items() for x in (F.lit(k), F.array(*map(F.lit, labels)))])
    of_site = F.flatten(F.transform("categories", lambda c: F.coalesce(F.try_element_at(by_kind, c), F.array().cast("array<string>"))))
    of_page = F.array_compact(F.array(*[F.when(F.expr(when), label) for when, label in OFFERS]))
    offers = F.slice(F.array_distinct(F.concat(of_site, of_page)), 1, OFFERED)
    return pages.select(key, F.posexplode(offers).alias("place", "label")).withColumn("place", F.col("place") + 1)
