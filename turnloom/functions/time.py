"""Days that a look-back window or a calendar unit starts on. Clocks are parameters: nothing reads the time of day by itself."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

UNITS = {"m": timedelta(minutes=1), "h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1)}


def since_day(value: str | None, now: datetime) -> str | None:
    """The day of ``now``'s zone that 30m, 12h, 7d, 2w or an ISO time means; nothing gives null, anything else an error."""
    if not value:
        return None
    if m := re.fullmatch(r"(\d+)([mhdw])", value.strip(), re.IGNORECASE):
        moment = now - int(m[1]) * UNITS[m[2].lower()]
    else:
        try:
            moment = datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"{value!r} is neither an ISO time nor a window such as 30m, 12h, 7d or 2w") from None
        # A day alone is midnight in UTC; a time without a zone is one of ``now``'s.
        zone = timezone.utc if len(value.strip()) == 10 else now.tzinfo
        moment = moment if moment.tzinfo else moment.replace(tzinfo=zone)
        moment = moment.astimezone(now.tzinfo)
    return moment.date().isoformat()


def start_of_day(now: datetime) -> str:
    return now.date().isoformat()


def start_of_week(now: datetime) -> str:
    """Its Monday."""
    return (now.date() - timedelta(days=now.weekday())).isoformat()


def start_of_month(now: datetime) -> str:
    return date(now.year, now.month, 1).isoformat()
