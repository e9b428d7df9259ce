"""The small labelled URL table that the URL filter learns from (fixed values)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 1 = block, 0 = allow.
BLOCKED = (
    "http://casino-bonus.example.com/win/free-spins",
    "https://play.jackpot.example.net/slots/777",
    "http://cheap-pills.example.com/viagra/order",
    "https://adult-cams.example.net/xxx/live",
    "http://free-porn.example.com/videos/12",
    "https://loan-payday.example.net/apply/now",
    "http://win-prize.example.com/claim?id=9",
    "https://poker.betting.example.net/bonus",
    "http://replica-watches.example.com/buy/cheap",
    "https://xxx-movies.example.net/hot/1",
    "http://crypto-doubler.example.com/double/btc",
    "https://weight-loss-pills.example.net/buy",
    "http://warez.example.com/crack/keygen",
    "https://torrent-crack.example.net/serial/2",
    "http://sexy-dates.example.com/meet/now",
    "https://slots-casino.example.net/free/bonus",
    "http://buy-followers.example.com/cheap/seo",
    "https://seo-backlinks.example.net/buy/links",
    "http://spam.example.com/click/here/win",
    "https://ads.tracker.example.net/click/redirect",
)
ALLOWED = (
    "https://blog.example.com/en/2041",
    "https://m.example.net/fr/881#top",
    "http://www.library.example.org/en/17.html",
    "https://news.example.net/de/5531?page=2",
    "http://school.example.com/es/120",
    "https://museum.example.org/fr/notes/3",
    "https://www.weather.example.net/en/today/",
    "http://garden.example.com/en/plants/14",
    "https://recipes.example.net/es/soup/7",
    "http://blog.history.example.org/de/99",
    "https://science.example.com/en/articles/36675",
    "http://m.example.net/de/47607.html",
    "https://docs.example.com/en/guide/install",
    "https://forum.example.net/en/thread/4411",
    "http://www.city.example.org/fr/council",
    "https://music.example.com/en/album/8",
    "http://travel.example.net/es/madrid/2",
    "https://university.example.org/en/course/5",
    "http://www.books.example.com/de/roman/44",
    "https://photos.example.net/en/20117",
)


# Words of hosts that are unwanted, of hosts that are not, and what paths of both end in.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "roulette", "lottery", "bingo", "gamble", "bet", "bets", "betting", "wager", "win", "winner", "prize", "bonus", "free", "cheap", "pills", "viagra", "cialis", "steroid", "pharma", "slimming",
    "loan", "loans", "payday", "cash", "profit", "doubler", "replica", "fake", "porn", "xxx", "sexy", "adult", "cams", "hookup", "escort", "dates", "warez", "crack", "keygen", "torrent", "spam", "scam", "ads", "adserver",
    "banner", "popup", "click", "track", "tracker", "redirect", "seo", "backlinks", "followers", "deals",
)
ORDINARY = (
    "library", "school", "museum", "weather", "garden", "recipes", "history", "science", "docs", "forum", "city", "music", "travel", "university", "books", "photos", "news", "journal", "hospital", "theatre", "radio", "maps", "river", "mountain",
    "kitchen", "bread", "football", "research", "physics", "chemistry", "archive", "gallery", "festival", "council", "railway", "airport", "nature", "birds", "novel", "poems", "language", "teacher", "student", "health", "doctor", "family", "painting", "cinema",
    "software", "data", "tools", "wind", "window", "winter", "sister", "letters", "better", "tractor", "wings", "charity",
)
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog.", "", "my."), (".example.com", ".example.net", ".example.org", ".org", ".com")
PLAIN_PATHS = ("/en/{0}", "/de/{0}.html", "/fr/{0}/", "/es/{0}", "/", "/index.html", "/a/{0}/b")
LOADED_PATHS = (("/win/free-spins", "/buy/cheap/{0}", "/click/redirect", "/bonus/claim", "/xxx/live/{0}"), ("/articles/{0}", "/course/history", "/notes/garden", "/guide/install", "/photos/{0}"))
ONSETS, VOWELS, CODAS = "b c ch d f g h l m n p r s sh st t th tr v w wh".split(), "a e i o u ea ou".split(), ("", "n", "r", "st", "", "nd", "ng", "th", "l", "s", "ly")


def name(i: int) -> str:
    """A made-up name of two or three syllables that means nothing."""
    return "".join(ONSETS[(i * m + i // m) % len(ONSETS)] + VOWELS[(i // 2 + i * m) % len(VOWELS)] + CODAS[(i + i // m) % len(CODAS)] for m in (5, 8, 13)[: 2 + i % 2])


def made(first: int, count: int) -> list[tuple[str, int]]:
    """``(url, label)``: numbers ``first`` and up of a series of urls whose hosts alone tell; three each, an unwanted host, an ordinary one and a name.

    Of four hosts of the first two kinds two have two words, one has one, and the fourth has a word beside a name. Names alone are ordinary: most names
    mean nothing. Prefixes, endings and plain paths are dealt to all alike.
    """
    out = []
    for i in range(first, first + count):
        loaded = i % 3 == 0
        for label, words in ((1, UNWANTED), (0, ORDINARY), (0, None)):
            if words is None:
                host = name(i + 7)
            else:
                a, b = words[i % len(words)], words[(i * 7 + 3 + i // len(words)) % len(words)]
                host = (f"{a}-{b}", f"{a}{b}", a, f"{a}-{name(i)}")[i % 4]
            path = (LOADED_PATHS[1 - label] if loaded else PLAIN_PATHS)[(i // 3) % (5 if loaded else 7)]
            out.append((f"http{'s' * (i % 2)}://{PREFIXES[i % 6]}{host}{SUFFIXES[(i // 2) % 5]}{path.format(i * 37 % 9973)}", label))
    return out


#: How many numbers of the series are learned from: three urls each.
MADE = 240


def labelled(spark: SparkSession) -> DataFrame:
    """``(url, label)``, made inside the plan."""
    known = [(u, k) for k, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls] + made(0, MADE)
    rows = [F.struct(F.lit(u).alias("url"), F.lit(k).alias("label")) for u, k in known]
    return spark.range(1).select(F.inline(F.array(*rows)))


# The rules of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
