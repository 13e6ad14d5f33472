"""Exchange clock as column expressions. Instants are UTC; zones only appear in
derived columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHICAGO = "America/Chicago"
NEW_YORK = "America/New_York"

# Full-day exchange holidays.
HOLIDAYS = [
    "2024-01-01", "2024-12-25", "2025-01-01", "2025-01-09", "2025-12-25",
    "2026-01-01", "2026-12-25", "2027-01-01", "2027-12-24",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_time(ts, tz: str) -> Column:
    return F.from_utc_timestamp(_c(ts), tz)


def contract_id_full(contract, ts) -> Column:
    """Contract code plus year, which tells decades apart."""
    return F.concat_ws("_", _c(contract), F.year(_c(ts)).cast("string"))


def month_code(contract) -> Column:
    """Month letter before the trailing year digits; null for a malformed code."""
    # Delivery month letters January to December.
    letters = "FGHJKMNQUVXZ"
    m = F.regexp_extract(F.trim(_c(contract)), rf"^.+([{letters}])[0-9]+$", 1)
    return F.when(m != "", m)


def session_date(ts, tz: str, shift_h: int = 7) -> Column:
    return F.to_date(local_time(ts, tz) + F.make_dt_interval(hours=F.lit(shift_h)))


def root_symbol(contract, roots: list[str]) -> Column:
    """The longest listed prefix of the code, else the code itself."""
    code = _c(contract)
    out = None
    for r in sorted(roots, key=len, reverse=True):
        hit = code.startswith(r)
        out = F.when(hit, F.lit(r)) if out is None else out.when(hit, F.lit(r))
    return code if out is None else out.otherwise(code)


def with_local_clock(df: DataFrame, tz: str, ts: str = "ts") -> DataFrame:
    lt = local_time(ts, tz)
    return df.withColumns({
        "local_date": F.to_date(lt),
        "local_hour": F.hour(lt),
        "local_minute": F.minute(lt),
        "local_hhmm": F.date_format(lt, "HH:mm"),
    })


def in_clock_window(df: DataFrame, first: str, last: str) -> DataFrame:
    """Keep local times from ``first`` to ``last``, both ends included."""
    return df.filter(F.col("local_hhmm").between(first, last))


def _is_in(day: Column, days: list[str]) -> Column:
    return day.isin([dt.date.fromisoformat(d) for d in days]) if days else F.lit(False)


def _seconds(lt: Column) -> Column:
    """Microseconds since local midnight."""
    return F.unix_micros(lt) - F.unix_micros(F.date_trunc("day", lt))


def _hm(h: int, m: int = 0) -> Column:
    return F.lit((h * 60 + m) * 60 * 1_000_000)


def session_of(ts, early_closes: dict[str, str] | None = None,
               holidays: list[str] | None = None) -> Column:
    """RTH, ETH, OVN or HALT in exchange (Chicago) time."""
    lt = local_time(ts, CHICAGO)
    day, wd, t = F.to_date(lt), F.weekday(lt), _seconds(lt)
    closed_early = F.lit(False)
    for d, hhmm in (early_closes or {}).items():
        h, m = (int(x) for x in hhmm.split(":"))
        closed_early = closed_early | ((day == F.lit(dt.date.fromisoformat(d))) & (t >= _hm(h, m)))
    return (
        F.when(_is_in(day, HOLIDAYS if holidays is None else holidays), "HALT")
        .when(wd == 5, "HALT")
        .when(wd == 6, F.when(t < _hm(17), "HALT").otherwise("OVN"))
        .when((wd == 4) & (t >= _hm(16)), "HALT")
        .when((t >= _hm(16)) & (t < _hm(17)), "HALT")
        .when(closed_early, "HALT")
        .when((t >= _hm(8, 30)) & (t < _hm(15, 15)), "RTH")
        .when((wd == 0) & (t < _hm(8, 30)), "OVN")
        .otherwise("ETH")
    )


def longest_closure(holidays: list[str]) -> int:
    """Most days in a row without trading, weekends included."""
    shut = {dt.date.fromisoformat(d) for d in holidays}
    longest = 2
    for d in shut:
        n, day = 0, d
        while day in shut or day.weekday() >= 5:
            n, day = n + 1, day + dt.timedelta(days=1)
        day = d - dt.timedelta(days=1)
        while day in shut or day.weekday() >= 5:
            n, day = n + 1, day - dt.timedelta(days=1)
        longest = max(longest, n)
    return longest


def _open_day(day: Column, holidays: list[str]) -> Column:
    """First open weekday from ``day`` on; no closure is longer than the one looked for."""
    closed = F.array(*[F.lit(dt.date.fromisoformat(d)) for d in holidays]) if holidays else None
    out = None
    for k in range(longest_closure(holidays), -1, -1):
        d = F.date_add(day, k)
        is_open = F.weekday(d) < 5
        if closed is not None:
            is_open = is_open & ~F.array_contains(closed, d)
        out = F.when(is_open, d) if out is None else F.when(is_open, d).otherwise(out)
    return out


def trading_day(ts, holidays: list[str] | None = None) -> Column:
    """Settlement date: the day rolls at 17:00 Chicago (Friday at 16:00)."""
    lt = local_time(ts, CHICAGO)
    wd, t = F.weekday(lt), _seconds(lt)
    ahead = (
        F.when((wd == 4) & (t >= _hm(16)), 3)
        .when(wd == 5, 2)
        .when(wd == 6, 1)
        .when((wd <= 3) & (t >= _hm(17)), 1)
        .otherwise(0)
    )
    return _open_day(F.date_add(F.to_date(lt), ahead), HOLIDAYS if holidays is None else holidays)


def energy_session(ts) -> Column:
    """ACTIVE, MAINTENANCE_BREAK (open interval 16-17 Mon-Thu) or WEEKEND_CLOSED."""
    lt = local_time(ts, CHICAGO)
    wd, t = F.weekday(lt), _seconds(lt)
    return (
        F.when(wd == 5, "WEEKEND_CLOSED")
        .when((wd == 6) & (t < _hm(17)), "WEEKEND_CLOSED")
        .when((wd == 4) & (t > _hm(16)), "WEEKEND_CLOSED")
        .when((wd <= 3) & (t > _hm(16)) & (t < _hm(17)), "MAINTENANCE_BREAK")
        .otherwise("ACTIVE")
    )


def iso_week_id(day) -> Column:
    """ISO year * 100 + ISO week."""
    d = _c(day)
    return F.extract(F.lit("YEAROFWEEK"), d).cast("long") * 100 + F.weekofyear(d)


def et_to_utc(day, hour, minute) -> Column:
    """Wall-clock New York time of a date as a UTC instant."""
    d = F.to_timestamp(_c(day))
    h = F.lit(hour) if isinstance(hour, int) else hour
    m = F.lit(minute) if isinstance(minute, int) else minute
    return F.to_utc_timestamp(d + F.make_dt_interval(hours=h, mins=m), NEW_YORK)


def dow_onehot(day) -> dict[str, Column]:
    """Monday to Thursday flags; Friday is the reference."""
    wd = F.weekday(_c(day))
    return {n: (wd == i).cast("int") for i, n in enumerate(["mon", "tue", "wed", "thu"])}
