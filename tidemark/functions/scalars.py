"""Scalar functions: returns, units, calendar, known-at moments, tiers, text and arrays. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUNCE, OUNCE_FINE = 31.1035, 31.1034768  # fixed values: grams in a troy ounce, in the two precisions in use
PURITY, KARAT_22 = 0.916, 22 / 24  # fixed values: the two purities in use
TAX = 0.03


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positive(c) -> Column:
    """The value if it is finite and above zero, else null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def log_return(a, b) -> Column:
    a, b = positive(a), positive(b)
    return F.ln(b / a)


def pct_change(a, b) -> Column:
    a = positive(a)
    return col(b) / a - 1


def price_bounds(price, lower_log, upper_log) -> tuple[Column, Column]:
    return col(price) * F.exp(col(lower_log)), col(price) * F.exp(col(upper_log))


def sign_agrees(a, b) -> Column:
    """Whether two moves go the same way; a zero move never agrees."""
    a, b = F.signum(col(a)), F.signum(col(b))
    return (a * b) > 0


def round_half_up(c) -> Column:
    return F.floor(col(c) + 0.5)


def round_half_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def times_of_ten(c) -> Column:
    return F.floor(10 * col(c) + 1e-9).cast("int")


def strict_number(text) -> Column:
    """A number written as plain digits; null for anything else."""
    t = col(text)
    return F.when(t.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), t.try_cast("double"))


def normal_bounds(mean, sd, z: float) -> tuple[Column, Column]:
    return col(mean) - z * col(sd), col(mean) + z * col(sd)


def implied_sd(lower, upper, z: float = 1.6448536269514722) -> Column:
    """Standard deviation implied by a central 90 % interval."""
    return (col(upper) - col(lower)) / (2 * z)


def garch_variance(last_var, omega: float, alpha: float, beta: float, days: int) -> Column:
    """Sum of the variance forecasts of the next `days` days in closed form."""
    keep = alpha + beta
    if abs(1 - keep) < 1e-12:
        return days * col(last_var) + omega * days * (days - 1) / 2
    flat = omega / (1 - keep)
    return days * flat + (col(last_var) - flat) * ((1 - keep**days) / (1 - keep))


def sigmoid(c, clip: float = 40.0) -> Column:
    x = F.greatest(F.lit(-clip), F.least(F.lit(clip), col(c)))
    return 1 / (1 + F.exp(-x))


def logit(c, clip: float = 1e-6) -> Column:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), col(c)))
    return F.ln(p / (1 - p))


def winkler(lower, upper, actual, alpha: float) -> Column:
    lo, hi, y = col(lower), col(upper), col(actual)
    return (hi - lo) + F.when(y < lo, 2 / alpha * (lo - y)).when(y > hi, 2 / alpha * (y - hi)).otherwise(0.0)


def qlike(variance, realised) -> Column:
    v, r = positive(variance), positive(realised)
    return r / v - F.ln(r / v) - 1


def cqr_score(lower, upper, actual) -> Column:
    """How far the actual lies outside its band; negative inside."""
    return F.greatest(col(lower) - col(actual), col(actual) - col(upper))


def tier(c, cuts: list[tuple[float, str]], last: str) -> Column:
    """The first name whose limit the value does not exceed; null stays null."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, name in cuts:
        out = out.when(x <= limit, name)
    return out.otherwise(last)


def local_date(ts, tz: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), tz))


def local_moment(day, clock: str, tz: str) -> Column:
    """The UTC instant of a local wall clock (HH:MM) on a day, summer time included."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", col(day).cast("string"), F.lit(clock + ":00"))), tz)


def known_at(published, fetched=None) -> Column:
    """When a value could be used: not before it was published nor before it was fetched."""
    return col(published) if fetched is None else F.greatest(col(published), col(fetched))


def weekdays_from(a, b) -> Column:
    """Weekdays in [a, b): closed form."""

    def upto(d):  # weekdays in [1970-01-05, d)
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return (upto(col(b)) - upto(col(a))).cast("int")


def business_days_since(a, b) -> Column:
    """Weekdays in (a, b]; 0 if b is not after a."""
    return F.greatest(F.lit(0), weekdays_from(F.date_add(col(a), 1), F.date_add(col(b), 1)))


def consecutive(a, b, most: int = 2) -> Column:
    return weekdays_from(a, b) <= most


def in_season(day, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether month and day lie in [start, end], across the year's end if need be."""
    k = F.month(col(day)) * 100 + F.dayofmonth(col(day))
    a, b = start[0] * 100 + start[1], end[0] * 100 + end[1]
    return k.between(a, b) if a <= b else (k >= a) | (k <= b)


def weekday0(day) -> Column:
    """0 for Monday."""
    return F.weekday(col(day))


def week_of(day) -> Column:
    return F.to_date(F.date_trunc("week", col(day)))


def parse_strict(text) -> tuple[Column, Column]:
    """Timestamp and, where there is none, the reason."""
    t = col(text)
    value = F.try_to_timestamp(t)
    why = F.when(t.isNull(), "missing").when(F.trim(t) == "", "empty").when(value.isNull(), "unparseable").when(F.year(value) < 2000, "epoch placeholder")
    return F.when(why.isNull(), value), why


def after_holidays(day, holidays: list[str]) -> Column:
    """The first day from `day` on that is neither a weekend nor a holiday (within ten days)."""
    days = F.sequence(col(day), F.date_add(col(day), 10))
    free = [F.lit(h).cast("date") for h in holidays]
    ok = F.filter(days, lambda d: (F.weekday(d) < 5) & ~(d.isin(*free) if free else F.lit(False)))
    return F.try_element_at(ok, F.lit(1))


def hours_without_sundays(a, b) -> Column:
    """Elapsed hours less those that fall on Sundays."""
    x, y = (F.unix_micros(col(c).cast("timestamp")) / 3.6e9 for c in (a, b))

    def sundays(h):  # Sunday hours before h; hour 0 was a Thursday, the first Sunday began at 72
        n = h - 72
        week = F.floor(n / 168)
        return week * 24 + F.least(n - week * 168, F.lit(24.0))

    return (y - x) - (sundays(y) - sundays(x))


def quiet(ts, start: int = 22, end: int = 7, tz: str = "Asia/Kolkata") -> Column:
    h = F.hour(F.from_utc_timestamp(col(ts).cast("timestamp"), tz))
    return (h >= start) | (h < end) if start > end else (h >= start) & (h < end)


def minute_of_day(ts, tz: str = "Asia/Kolkata") -> Column:
    t = F.from_utc_timestamp(col(ts).cast("timestamp"), tz)
    return F.hour(t) * 60 + F.minute(t)


def regex_number(text, pattern: str, group: int = 1) -> Column:
    """The first match of a group as a number; thousands separators are dropped."""
    m = F.regexp_extract(col(text), pattern, group)
    return F.when(m != "", F.regexp_replace(m, ",", "").try_cast("double"))


def retry_after(text, now) -> Column:
    """Seconds to wait from a Retry-After value in seconds or as an HTTP date; null if it is neither."""
    t = F.trim(col(text))
    at = F.try_to_timestamp(F.regexp_replace(t, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (F.unix_micros(at) - F.unix_micros(col(now).cast("timestamp"))) / 1e6
    return F.when(t.rlike(r"\A[0-9]+\z"), t.try_cast("double")).when(at.isNotNull(), F.greatest(F.lit(0.0), wait))


def backoff(attempt, base: float = 1.0, most: float = 60.0, key=None) -> Column:
    """base x 2^attempt up to most, with a jitter in [0.5, 1) taken from a hash of the key."""
    wait = F.least(F.lit(most), base * F.pow(F.lit(2.0), col(attempt)))
    return wait if key is None else wait * (0.5 + F.pmod(F.xxhash64(col(key)), F.lit(1000)) / 2000)


def derived_source(source, prefix: str = "derived") -> Column:
    return F.coalesce(col(source).startswith(prefix), F.lit(False))


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def k_sums(values, k: int) -> Column:
    """Sums of each k consecutive elements of an array."""
    v = col(values)
    return F.when(F.size(v) >= k, F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.aggregate(F.slice(v, i, k), F.lit(0.0), lambda a, x: a + x))).otherwise(F.array().cast("array<double>"))


def argmin(values) -> Column:
    """Place (from 0) of the first least element."""
    v = col(values)
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def lookup(key, table: dict, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[col(key)], F.lit(default))


def karat(price_22, k: int) -> Column:
    return col(price_22) * k / 22


def landed_rate(usd_ounce, usd_inr, duty, purity: float = KARAT_22, ounce: float = OUNCE_FINE) -> Column:
    """Price per gram at home: ounce to gram, exchange rate, duty (as a share), purity."""
    return col(usd_ounce) / ounce * col(usd_inr) * (1 + col(duty)) * purity


def purchase_cost(rate, grams: float, making: float, tax: float = TAX) -> Column:
    return col(rate) * grams * (1 + making) * (1 + tax)


def recency_weight(age_rows, halflife: float) -> Column:
    return F.pow(F.lit(0.5), col(age_rows) / halflife)
