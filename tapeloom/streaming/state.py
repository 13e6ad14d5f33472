"""State steps shared by the stateful streams and their batch twins.

Each step takes a small state and the rows of one key in time order; Spark keeps
the state, routes the keys and replays lost work.
"""

from __future__ import annotations

import datetime as dt
import heapq
import math
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Detector:
    """Run-length detector with a normal-inverse-gamma model, and its pause rule; all run lengths are kept."""

    hazard: float = 1 / 250
    window: int = 60
    threshold: float = 0.5
    re_entry: str = "posterior"  # posterior, count or manual
    re_entry_threshold: float = 0.2
    re_entry_count: int = 60
    min_pause: int = 20
    after: str = "fresh"  # run lengths after a pause: fresh, or kept
    mu0: float = 0.0
    kappa0: float = 1.0
    alpha0: float = 1.0
    beta0: float = 1.0

    def __post_init__(self):
        if not 0 < self.hazard <= 1 or self.window < 2 or not 0 < self.threshold < 1:
            raise ValueError("hazard in (0, 1], window >= 2 and threshold in (0, 1) are needed")
        if not 0 < self.re_entry_threshold < self.threshold:
            raise ValueError("the re-entry threshold must lie below the pause threshold")
        if self.re_entry not in ("posterior", "count", "manual") or self.after not in ("fresh", "kept"):
            raise ValueError("re_entry is posterior, count or manual; after is fresh or kept")
        if min(self.re_entry_count, self.min_pause) < 1:
            raise ValueError("re_entry_count and min_pause are at least 1")
        if min(self.kappa0, self.alpha0, self.beta0) <= 0:
            raise ValueError("kappa0, alpha0 and beta0 must be positive")

    @property
    def warm_up(self) -> int:
        """Observations without a signal: no run is as long as the half window yet."""
        return max(1, self.window // 2)


def fresh(cfg: Detector) -> tuple:
    """(log probabilities, means, betas); kappa and alpha follow from the run length."""
    return np.zeros(1), np.array([cfg.mu0]), np.array([cfg.beta0])


def _log_sum(x: np.ndarray) -> float:
    top = float(np.max(x))
    return top if not math.isfinite(top) else top + math.log(float(np.sum(np.exp(x - top))))


class _Ages:
    """What a run length alone decides: kappa, the degrees of freedom and the density's constant.

    Grown by doubling, so a series of any length pays for each age once.
    """

    def __init__(self, kappa0: float, alpha0: float) -> None:
        self.kappa0, self.alpha0 = kappa0, alpha0
        self.lgamma = np.array([math.lgamma(alpha0)])
        self._fill()

    def _fill(self) -> None:
        n = len(self.lgamma) - 1
        age = np.arange(n)
        self.kappa, self.df = self.kappa0 + age, 2 * self.alpha0 + age
        # Half a degree of freedom is alpha; the next age's is half of one more.
        self.constant = np.diff(self.lgamma) - 0.5 * np.log(self.df * math.pi)
        self.spread = (self.kappa + 1) / (self.df / 2 * self.kappa)

    def upto(self, n: int):
        if len(self.kappa) < n:
            have = len(self.lgamma)
            more = [math.lgamma(self.alpha0 + k / 2) for k in range(have, max(n, 2 * have) + 1)]
            self.lgamma = np.concatenate([self.lgamma, more])
            self._fill()
        return self.kappa[:n], self.df[:n], self.constant[:n], self.spread[:n]


@lru_cache(maxsize=16)
def _ages(kappa0: float, alpha0: float) -> _Ages:
    return _Ages(kappa0, alpha0)


def observe(run: tuple, x: float, cfg: Detector) -> tuple[tuple, float]:
    """One observation: the new run-length state and the mass on recent changes."""
    logp, mu, beta = run
    kappa, df, constant, spread = _ages(cfg.kappa0, cfg.alpha0).upto(len(logp))
    off = (x - mu) ** 2
    scale2 = beta * spread
    joint = logp + constant - 0.5 * np.log(scale2) - (df + 1) / 2 * np.log1p(off / (df * scale2))
    total = _log_sum(joint)
    stay = math.log1p(-cfg.hazard) if cfg.hazard < 1 else -math.inf
    # Change and growth share the evidence, so it normalises both.
    logp = np.concatenate(([math.log(cfg.hazard)], joint - total + stay))
    grown = beta + kappa * off / (2 * (kappa + 1))
    mu = np.concatenate(([cfg.mu0], (kappa * mu + x) / (kappa + 1)))
    beta = np.concatenate(([cfg.beta0], grown))
    return (logp, mu, beta), float(np.exp(logp[:cfg.warm_up]).sum())


@dataclass(frozen=True)
class Pause:
    """A detector with its pause rule: what one series carries from session to session."""

    run: tuple
    seen: int = 0
    paused: bool = False
    since: int = 0
    entered: dt.date | None = None
    entered_posterior: float | None = None
    posterior: float = 0.0
    session: dt.date | None = None
    commands: tuple = field(default=())


def new_pause(cfg: Detector) -> Pause:
    return Pause(fresh(cfg))


# One row of output; the pause log is the rows that resume.
PAUSE_COLUMNS = ["session", "posterior", "paused", "event", "entered", "entered_posterior", "duration"]


def _left(st: Pause, cfg: Detector) -> Pause:
    return replace(st, run=fresh(cfg) if cfg.after == "fresh" else st.run, paused=False, since=0, entered=None, entered_posterior=None)


def pause_session(st: Pause, session: dt.date, x: float, cfg: Detector) -> tuple[Pause, tuple]:
    """One session's return: advance the detector, then enter or leave a pause.

    In warm-up the counter runs as if paused, but no pause is entered.
    """
    run, mass = observe(st.run, x, cfg)
    st = replace(st, run=run, seen=st.seen + 1, posterior=mass, session=session)
    if not st.paused and st.seen >= cfg.window // 2:
        if mass <= cfg.threshold:
            return st, (session, mass, False, "", None, None, None)
        st = replace(st, paused=True, since=0, entered=session, entered_posterior=mass)
        return st, (session, mass, True, "pause", session, mass, None)
    st = replace(st, since=st.since + 1)
    done = st.since >= cfg.min_pause and (
        (cfg.re_entry == "posterior" and mass < cfg.re_entry_threshold)
        or (cfg.re_entry == "count" and st.since >= cfg.re_entry_count))
    if not done:
        return st, (session, mass, st.paused, "", st.entered, st.entered_posterior, None)
    row = (session, mass, False, "resume" if st.paused else "", st.entered, st.entered_posterior, st.since if st.paused else None)
    return _left(st, cfg), row


def pause_command(st: Pause, session: dt.date, cfg: Detector) -> tuple[Pause, tuple]:
    """An operator's order to resume, given at the end of ``session``.

    It counts in a pause of the shortest length or more, if the rule leaves resuming to
    operators; otherwise it is refused, and the row says so.
    """
    if not st.paused or cfg.re_entry != "manual" or st.since < cfg.min_pause:
        return st, (session, st.posterior, st.paused, "refused", st.entered, st.entered_posterior, None)
    return _left(st, cfg), (session, st.posterior, False, "manual", st.entered, st.entered_posterior, st.since)


def pause_rows(st: Pause, returns: list[tuple], commands: list[dt.date], cfg: Detector) -> tuple[Pause, list[tuple]]:
    """Rows of some sessions (in order) and orders.

    An order waits until its session has been seen, so it may arrive before the return does;
    one for a session that is past is carried out at once. ``Pause.commands`` holds those that wait.
    """
    waiting = sorted([*st.commands, *commands])
    rows = []

    def carry_out(upto: dt.date | None) -> None:
        nonlocal st
        while waiting and upto is not None and waiting[0] <= upto:
            st, row = pause_command(st, waiting.pop(0), cfg)
            rows.append(row)

    for session, x in returns:
        # Orders given on days without a return come first.
        carry_out(session - dt.timedelta(days=1))
        st, row = pause_session(st, session, x, cfg)
        rows.append(row)
        carry_out(session)
    carry_out(st.session)
    return replace(st, commands=tuple(waiting)), rows


def decay_path(xs: list[float], cfg: Detector) -> list[float]:
    """Mass on recent changes at every observation of a whole series; 0 in warm-up, where it means nothing."""
    run, out = fresh(cfg), []
    for k, x in enumerate(xs):
        run, mass = observe(run, float(x), cfg)
        out.append(0.0 if k < cfg.window // 2 else mass)
    return out


@dataclass(frozen=True)
class StepUp:
    """Sizing ladder: up a step while nothing decays, down when something does."""

    grid: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 2.5)
    start: float = 1.5
    every: int = 60
    mppm_window: int = 60
    delta_t: float = 1 / 252
    detector: Detector = Detector(hazard=0.01)


def ladder_step(st: dict, x: float, cfg: StepUp) -> tuple[dict, str]:
    """One session: extend the rolling measure, feed the detector, step when due.

    A decay seen once stays seen, since every check looks at the whole path.
    """
    recent = (st["recent"] + [x])[-cfg.mppm_window:]
    n, path, run, decayed = st["n"] + 1, st["path"], st["run"], st["decayed"]
    if len(recent) == cfg.mppm_window and min(recent) > -1:
        value = float(np.mean(np.log1p(recent)) / cfg.delta_t)
        run, mass = observe(run, value, cfg.detector)
        decayed = decayed or (path >= cfg.detector.window // 2 and mass > cfg.detector.threshold)
        path += 1
    idx, checked, action = st["idx"], st["checked"], ""
    if n - checked >= cfg.every:
        checked = n
        if path < cfg.detector.window:
            action = "warmup_hold"
        elif decayed:
            action = "halve" if idx > 0 else "hold_min"
            idx = max(idx - 1, 0)
        else:
            action = "step_up" if idx + 1 < len(cfg.grid) else "hold_max"
            idx = min(idx + 1, len(cfg.grid) - 1)
    return {"recent": recent, "n": n, "path": path, "run": run, "decayed": decayed, "idx": idx,
            "checked": checked}, action


def new_ladder(cfg: StepUp) -> dict:
    return {"recent": [], "n": 0, "path": 0, "run": fresh(cfg.detector), "decayed": False,
            "idx": cfg.grid.index(cfg.start), "checked": 0}


@dataclass(frozen=True)
class Limits:
    """Entry rules of one account, checked in the order of ``rules``; the first that fires is the reason.

    ``open``: the symbol has a position; ``cap``: the size is above the symbol's cap (``cap`` where
    ``caps`` has none); ``daily``/``weekly``: the realised P&L of the session or week is below that
    share of the equity it began with.
    """

    start: float = 100_000.0
    rules: tuple[str, ...] = ("open", "cap", "daily", "weekly")
    caps: tuple[tuple[str, float], ...] = ()
    cap: float = 1.0
    daily: float = -0.02
    weekly: float = -0.05

    def __post_init__(self):
        if not set(self.rules) <= {"open", "cap", "daily", "weekly"} or len(set(self.rules)) < len(self.rules):
            raise ValueError("rules are some of open, cap, daily and weekly, each once")
        if self.daily >= 0 or self.weekly >= 0 or self.start <= 0:
            raise ValueError("limits are negative shares of a positive equity")


@dataclass(frozen=True)
class Account:
    """Equity, the running session and week, and the open positions (exit_us, number, symbol, pnl, session, week)."""

    equity: float
    session: dt.date | None = None
    session_equity: float = 0.0
    session_pnl: float = 0.0
    week: int = -1
    week_equity: float = 0.0
    week_pnl: float = 0.0
    number: int = 0
    positions: tuple = ()


def guard_entries(acc: Account, trades: list[tuple], cfg: Limits) -> tuple[Account, list[str]]:
    """The reason each entry is blocked ("" if it is let in).

    ``trades``: (entry_us, exit_us, symbol, size, pnl, entry session and week, exit session and week) by
    entry time. Positions that end at or before an entry are realised first, in their exit session.
    Blocked trades open nothing and realise nothing.
    """
    caps, heap, out = dict(cfg.caps), list(acc.positions), []
    heapq.heapify(heap)
    held = Counter(h[2] for h in heap)
    # Plain names: the walk touches them for every trade.
    equity, number = acc.equity, acc.number
    day, day_equity, day_pnl = acc.session, acc.session_equity, acc.session_pnl
    wk, wk_equity, wk_pnl = acc.week, acc.week_equity, acc.week_pnl
    rules, cap, daily, weekly = cfg.rules, cfg.cap, cfg.daily, cfg.weekly
    for entry, exit_, symbol, size, pnl, session, week, exit_session, exit_week in trades:
        while heap and heap[0][0] <= entry:
            _, _, gone, made, s, w = heapq.heappop(heap)
            held[gone] -= 1
            # A new session or week starts from the equity so far.
            if s != day:
                day, day_equity, day_pnl = s, equity, 0.0
            if w != wk:
                wk, wk_equity, wk_pnl = w, equity, 0.0
            equity, day_pnl, wk_pnl = equity + made, day_pnl + made, wk_pnl + made
        if session != day:
            day, day_equity, day_pnl = session, equity, 0.0
        if week != wk:
            wk, wk_equity, wk_pnl = week, equity, 0.0
        reason = ""
        for rule in rules:
            if rule == "open":
                fires = held[symbol] > 0
            elif rule == "cap":
                fires = size > caps.get(symbol, cap)
            elif rule == "daily":
                fires = day_pnl < daily * day_equity
            else:
                fires = wk_pnl < weekly * wk_equity
            if fires:
                reason = rule
                break
        else:
            heapq.heappush(heap, (exit_, number, symbol, pnl, exit_session, exit_week))
            held[symbol] += 1
            number += 1
        out.append(reason)
    return Account(equity, day, day_equity, day_pnl, wk, wk_equity, wk_pnl, number, tuple(heap)), out
