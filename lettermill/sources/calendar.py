"""iCalendar in and out."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo


def _unfold(text: str) -> list[str]:
    return re.sub(r"\r?\n[ \t]", "", text).splitlines()


def _line(line: str) -> tuple[str, dict[str, str], str]:
    m = re.match(r'([A-Za-z0-9-]+)((?:;[^:;="]+=(?:"[^"]*"|[^:;]*))*):(.*)$', line)
    if not m:
        return "", {}, ""
    params = dict(p.split("=", 1) for p in re.findall(r';([^:;="]+=(?:"[^"]*"|[^:;]*))', m[2]))
    return m[1].upper(), {k.upper(): v.strip('"') for k, v in params.items()}, m[3]


def _time(value: str, params: dict[str, str]) -> int | None:
    """Seconds since 1970; times without a zone count as UTC."""
    try:
        if re.fullmatch(r"\d{8}", value):
            return int(datetime.strptime(value, "%Y%m%d").replace(tzinfo=timezone.utc).timestamp())
        t = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S")
        zone = timezone.utc if value.endswith("Z") or "TZID" not in params else ZoneInfo(params["TZID"])
        return int(t.replace(tzinfo=zone).timestamp())
    except (ValueError, KeyError, OSError):
        return None


def duration(value: str) -> int | None:
    m = re.fullmatch(r"([+-])?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", value)
    if not m:
        return None
    w, d, h, mi, s = (int(x or 0) for x in m.groups()[1:])
    return int(timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s).total_seconds()) * (-1 if m[1] == "-" else 1)


def parse_calendar(text: str | None) -> list[dict]:
    """kind (event or todo), uid, summary, start and end of each entry."""
    out, now = [], None
    for line in _unfold(text or ""):
        name, params, value = _line(line)
        if name == "BEGIN" and value.upper() in ("VEVENT", "VTODO"):
            now = {"kind": value[1:].lower(), "uid": None, "summary": None, "start": None, "end": None}
        elif name == "END" and now is not None and value.upper() in ("VEVENT", "VTODO"):
            out.append(now)
            now = None
        elif now is not None:
            if name in ("UID", "SUMMARY"):
                now[name.lower()] = re.sub(r"\\([\;,nN])", lambda m: "\n" if m[1] in "nN" else m[1], value)
            elif name == "DTSTART":
                now["start"] = _time(value, params)
            elif name in ("DTEND", "DUE"):
                now["end"] = _time(value, params)
            elif name == "DURATION" and now["start"] is not None and (d := duration(value)) is not None:
                now["end"] = now["start"] + d
    return out


def write_calendar(entries: list[dict]) -> str:
    escape = lambda s: re.sub(r"([\;,])", r"\\\1", s or "").replace("\n", "\\n")
    stamp = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//lettermill//EN"]
    for e in entries:
        kind = f"V{e['kind'].upper()}"
        lines += [f"BEGIN:{kind}", f"UID:{escape(e['uid'])}", f"SUMMARY:{escape(e['summary'])}"]
        lines += [f"DTSTART:{stamp(e['start'])}"] * (e["start"] is not None)
        lines += [f"{'DTEND' if kind == 'VEVENT' else 'DUE'}:{stamp(e['end'])}"] * (e["end"] is not None)
        lines.append(f"END:{kind}")
    lines.append("END:VCALENDAR")
    return "\r\n".join(x if len(x) <= 73 else "\r\n ".join(x[i : i + 73] for i in range(0, len(x), 73)) for x in lines) + "\r\n"
