"""Row-at-a-time reading of timestamp texts, written independently of the engine's expressions."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

NAMES = {}
for row in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
):
    NAMES |= {n: i for i, n in enumerate(row.split(), 1)}
ABBR = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2}
EPOCH = datetime(1970, 1, 1)


def us(naive):
    return (naive - EPOCH) // timedelta(microseconds=1)


def shows(zone, naive):
    out = set()
    for fold in (0, 1):
        t = naive.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        if t.astimezone(zone).replace(tzinfo=None) == naive:
            out.add(us(t.replace(tzinfo=None)))
    return sorted(out)


def read(text, tz, order):
    if text is None:
        return None
    t = " ".join(text.split())
    if re.fullmatch(r"\d{10}", t):
        return int(t) * 10**6
    if re.fullmatch(r"\d{13}", t):
        return int(t) * 10**3
    rest = None
    if m := re.match(r"(\d{4})-(\d\d)-(\d\d)(?!\d)", t):
        y, mo, d = map(int, m.groups())
    elif m := re.match(r"(\d{4})(\d\d)(\d\d)(?=T)", t):
        y, mo, d = map(int, m.groups())
        rest = re.sub(r"^T(\d\d)(\d\d)(\d\d)", r"T\1:\2:\3", t[m.end() :])
    elif m := re.match(r"(\d\d?)([/.])(\d\d?)\2(\d{4})", t):
        a, b, y = int(m[1]), int(m[3]), int(m[4])
        if order not in ("DMY", "MDY"):
            return None
        d, mo = (a, b) if order == "DMY" else (b, a)
    elif m := re.match(r"(?:\w{3}, )?(\d\d?)\.? (?:de )?([^\W\d]+)(?: de)? (\d{4})", t):
        d, mo, y = int(m[1]), NAMES.get(m[2].lower()), int(m[3])
    elif m := re.match(r"([^\W\d]+) (\d\d?), (\d{4})", t):
        d, mo, y = int(m[2]), NAMES.get(m[1].lower()), int(m[3])
    else:
        return None
    rest = t[m.end() :] if rest is None else rest
    try:
        day = datetime(y, mo, d)
    except (ValueError, TypeError):
        return None
    m = re.fullmatch(r"[T ]?(\d\d?):(\d\d):(\d\d)(?:\.(\d+))? ?([AaPp][Mm])? ?([A-Z]+|[+-]\d\d:?\d\d)?(\[.*\])?", rest)
    if rest and not m:
        return None
    whole, zone, naive = not rest, None, day
    if m:
        h, mi, s = int(m[1]), int(m[2]), int(m[3])
        if m[5]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (m[5].lower() == "pm")
        if mi > 59 or s > 59 or h > 24 or h == 24 and (mi or s):
            return None
        whole = h == 24
        naive = day + timedelta(hours=h, minutes=mi, seconds=s, microseconds=int(((m[4] or "") + "000000")[:6]))
        zone = m[6]
    if zone:
        if zone[0] in "+-":
            shift = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[-2:]))
        elif zone in ABBR:
            shift = ABBR[zone] * 60
        else:
            return None
        return us(naive) - shift * 60 * 10**6
    if not tz:
        return None
    found = shows(ZoneInfo(tz), naive)
    return found[0] if len(found) == 1 or whole and found else None
