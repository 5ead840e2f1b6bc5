"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words too common to search for.
STOP = tuple("a an and are as at be by for from has in is it of on or that the this to was were which with".split())
#: Secrets by their form, with what stays of them: key blocks, keys of clouds and services, signed tokens, names with a value, URL passwords.
SECRETS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", "***"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "***"),
    (r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|AIza)[-_0-9A-Za-z]{20,}", "***"),
    (r"\beyJ[-_0-9A-Za-z]{8,}\.[-_0-9A-Za-z]{8,}\.[-_0-9A-Za-z]{8,}", "***"),
    (r"(?i)\b((?:[a-z0-9]+[_-])*(?:key|token|secret|credential|credentials|pass|passphrase|passwd|password|pwd)[\"']?[ ]*[:=][ ]*[\"']?)[^\s,;\"']+", "$1***"),
    (r"(?i)\b((?:bearer|basic)[ ]+)[-._~+/=a-z0-9]{16,}", "$1***"),
    (r"([a-z]://[^\s/:@]*:)[^\s/@]+@", "$1***@"),
)
#: Very common words by language.
COMMON = {"en": ("the", "and", "of", "to", "is", "that"), "fr": ("le", "la", "les", "des", "et", "est")}


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), MARKED, FOLDED)


def words(c: Column) -> Column:
    """Folded words of letters and digits; camelCase and snake_case names are cut."""
    cut = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(fold(cut), r"[^a-z0-9]+", " "), " "), lambda x: x != "")


def stem(c: Column) -> Column:
    """A light stem: plural and -ing, -ed endings of longer words."""
    n = F.length(c)
    return (
        F.when((n > 4) & c.endswith("ies"), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & c.endswith("ing"), F.substring(c, F.lit(1), n - 3))
        .when((n > 4) & c.endswith("ed"), F.substring(c, F.lit(1), n - 2))
        .when((n > 3) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def telling_words(c: Column) -> Column:
    """The words of a text but for those in STOP."""
    cut = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.regexp_replace(fold(cut), r"[^a-z0-9]+", " "), " "), lambda x: (x != "") & ~x.isin(*STOP))


def terms(c: Column) -> Column:
    return F.transform(telling_words(c), stem)


def loose_key(c: Column) -> Column:
    """What stays of a value without case, separators and the leading zeros of its numbers."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", ""), r"(^|[a-z])0+([0-9])", "$1$2")


def mask_secrets(c: Column) -> Column:
    for pattern, by in SECRETS:
        c = F.regexp_replace(c, pattern, by)
    return c


def host(c: Column) -> Column:
    """The host of a URL, host:port or host."""
    return F.lower(F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))


def host_forms(c: Column) -> Column:
    """The names that a host goes by, in lower case: as written, without port, and its first label; an address has no short one."""
    full = host(c)
    low = F.lower(F.regexp_replace(F.trim(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|/.*$", ""))
    first = F.split_part(full, F.lit("."), F.lit(1))
    short = F.when((F.instr(full, ".") > 0) & first.rlike("[a-z]") & (F.length(first) >= 2), first)
    return F.array_distinct(F.filter(F.array(low, full, short), lambda x: x.isNotNull() & (x != "")))


def same_host(a: Column, b: Column) -> Column:
    """Whether two names may be one host: they share a form, and if both are full names they are the same one."""
    both_full = (F.instr(host(a), ".") > 0) & (F.instr(host(b), ".") > 0)
    return F.when(both_full, host(a) == host(b)).otherwise(F.arrays_overlap(host_forms(a), host_forms(b)))


def page_key(c: Column) -> Column:
    """What makes a URL the same page: host and path in lower case, without scheme, www, query, fragment or last slash."""
    bare = F.regexp_replace(F.lower(c), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def sql_shape(c: Column) -> Column:
    """A query with its literals as ? and its white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"'[^']*'", "?"), r"\b[0-9]+(\.[0-9]+)?\b", "?"), r"\s+", " "))


def trigrams(c: Column) -> Column:
    """Distinct character trigrams, each word padded with two blanks before and one after."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def language(c: Column) -> Column:
    """en or fr by common words, en on a tie; unclear where neither has two."""
    count = lambda ws: F.size(F.filter(words(c), lambda x: x.isin(*ws)))
    fr, en = count(COMMON["fr"]), count(COMMON["en"])
    return F.when(F.greatest(fr, en) < 2, "unclear").when(fr > en, "fr").otherwise("en")


#: Words that name a period, in English and French, in the order in which they are looked for.
PERIODS = (
    ("yesterday", r"\b(yesterday|hier)\b"), ("today", r"\b(today|aujourd'hui)\b"), ("last week", r"\b(last week|semaine derni[eè]re)\b"), ("this week", r"\b(this week|cette semaine)\b"),
    ("last month", r"\b(last month|mois dernier)\b"), ("this month", r"\b(this month|ce mois)\b"), ("weekend", r"\b(weekend|week-end)\b"),
)


def named_period(c: Column, reference: Column) -> Column:
    """(first, until) days, the last not included, of the period that a text names, seen from the day ``reference``; null where it names none.

    A written day (2024-01-31) comes first, then the last N days, then PERIODS; weeks begin on Monday, and the weekend is the last one that began.
    """
    low = F.lower(c)
    day = F.regexp_extract(low, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1).try_cast("date")
    count = F.regexp_extract(low, r"\b(?:last|past) ([0-9]{1,3}) days\b", 1)
    count = F.when(count != "", count).otherwise(F.regexp_extract(low, r"\b([0-9]{1,3}) derniers jours\b", 1))
    monday, month = F.date_trunc("week", reference).cast("date"), F.date_trunc("month", reference).cast("date")
    saturday = F.date_sub(reference, F.pmod(F.weekday(reference) - 5, F.lit(7)))
    spans = {
        "yesterday": (F.date_sub(reference, 1), reference), "today": (reference, F.date_add(reference, 1)), "last week": (F.date_sub(monday, 7), monday), "this week": (monday, F.date_add(monday, 7)),
        "last month": (F.add_months(month, -1), month), "this month": (month, F.add_months(month, 1)), "weekend": (saturday, F.date_add(saturday, 2)),
    }
    span = lambda a, b: F.struct(a.alias("first"), b.alias("until"))
    found = F.when(day.isNotNull(), span(day, F.date_add(day, 1))).when(count != "", span(F.date_sub(reference, count.try_cast("int") - 1), F.date_add(reference, 1)))
    for name, pattern in PERIODS:
        found = found.when(low.rlike(pattern), span(*spans[name]))
    return found


def business_label(day: Column, reference: Column) -> Column:
    """D, D-1, ... in weekdays from ``day`` back from ``reference``; null on weekends and later days."""
    weekday = lambda d: F.weekday(d)  # noqa: E731  Monday 0
    whole = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))  # noqa: E731  days since a Monday
    index = lambda d: F.floor(whole(d) / 7) * 5 + F.least(weekday(d), F.lit(4))
    back = (index(reference) - index(day)).cast("int")
    return F.when((weekday(day) > 4) | (day > reference), None).when(back == 0, "D").otherwise(F.concat(F.lit("D-"), back.cast("string")))
