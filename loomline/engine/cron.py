"""Cron expressions: five fields, or six with seconds first."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = {n: i for i, n in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)} | {n: i for i, n in enumerate("SUN MON TUE WED THU FRI SAT".split())}


class CronError(ValueError):
    pass


def _field(text: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if step and not step.isdigit() or step == "0":
            raise CronError(f"wrong step in {text!r}")
        if span in ("*", "?"):
            a, b = low, high
        else:
            ends = [_NAMES.get(x.upper(), int(x) if x.isdigit() else None) for x in span.split("-")]
            if None in ends or len(ends) > 2:
                raise CronError(f"wrong field {text!r}")
            a, b = ends[0], ends[-1] if len(ends) == 2 else (high if step else ends[0])
        if not low <= a <= b <= high:
            raise CronError(f"{text!r} is out of range")
        out.update(range(a, b + 1, int(step or 1)))
    return frozenset(out)


class Cron:
    def __init__(self, expression: str):
        fields = expression.split()
        if len(fields) == 5:
            fields = ["0", *fields]
        if len(fields) != 6:
            raise CronError(f"{expression!r} has {len(fields)} fields")
        self.second, self.minute, self.hour, self.day, self.month, week = (_field(f, *r) for f, r in zip(fields, _RANGES))
        self.week = frozenset(d % 7 for d in week)
        self.any_day, self.any_week = fields[3] in ("*", "?"), fields[5] in ("*", "?")

    def _day_fits(self, d: datetime) -> bool:
        by_day, by_week = d.day in self.day, (d.weekday() + 1) % 7 in self.week
        if self.any_day or self.any_week:
            return by_day and by_week
        return by_day or by_week

    def next_after(self, moment: datetime, zone: str = "UTC") -> datetime:
        """The first time after moment, in UTC; moment without a zone is UTC."""
        at = (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).astimezone(ZoneInfo(zone)).replace(microsecond=0, tzinfo=None) + timedelta(seconds=1)
        end = at + timedelta(days=366 * 8 + 2)
        while at < end:
            if at.month not in self.month:
                at = (at.replace(day=1, hour=0, minute=0, second=0) + timedelta(days=32)).replace(day=1)
            elif not self._day_fits(at):
                at = at.replace(hour=0, minute=0, second=0) + timedelta(days=1)
            elif at.hour not in self.hour:
                at = at.replace(minute=0, second=0) + timedelta(hours=1)
            elif at.minute not in self.minute:
                at = at.replace(second=0) + timedelta(minutes=1)
            elif at.second not in self.second:
                at += timedelta(seconds=1)
            else:
                return at.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
        raise CronError("no time ever fits")
