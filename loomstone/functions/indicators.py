"""Indicators of pages: a number before a unit in any of several languages, or a phrase that names a role or an installation."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words by kind; a star stands for any ending, an underscore for white space or none.
WORDS = {
    "scale": "million millions milhões millones مليون млн млн. миллион миллиона миллионов тыс тыс. тысяч тысяча тысячи",
    "passenger": "passengers passageiros pasajeros passagers pax пассажир пассажиров пассажира пассажиры ركاب مسافر مسافرين",
    "movement": "passenger_movements 人次", "cruise": "cruise_passengers",
    "ride": "passengers riders ridership passageiros pasajeros passagers voyageurs пассажир пассажиров пассажира пассажиры ركاب",
    "daily": "daily diários diarios quotidiens يوميا",
    "seat": (
        "seats seat_capacity capacity 座 asientos assentos lugares places capacidad capacité spectators espectadores spectateurs мест места"
        " зрител зрителей зрителя зрители зрительских_мест зрительские_места مقاعد متفرج"
    ),
    "seat_label": "seat_capacity capacity capacidad capacité вместимость",
    "holds": (
        "seats people spectators capacity asientos assentos lugares places personas pessoas personnes capacidad capacité мест места"
        " зрител зрителей зрителя зрители человек مقاعد أشخاص متفرج"
    ),
    "sqm": "sqm m2 ㎡ m² кв._м кв_м square_metres square_meters", "sqm_short": "sqm m2 ㎡ m² кв._м кв_м square_metres square_meters sq_m",
    "exhibition": "exhibition* exhibit* convention* exposição exposición exposition* congrès выставоч* павильон* конгресс* конференц* معرض مؤتمر",
    "meeting": "ballroom* meeting* conference* salão eventos reuniones banquetes réunion conférence конференц* банкет* зал* قاعة اجتماعات",
    "hall": "ballroom* conference*", "event": "events exhibitions conferences", "attendee": "delegates attendees people visitors", "guest": "guests delegates attendees",
    "kind_of_room": "modern guest comfortable stylish spacious уютных стильных современных комфортных гостевых просторных",
    "room": "keys guest_rooms guestrooms rooms habitaciones quartos apartamentos chambres номеров номера غرف",
    "visit": "visitors footfall visits visitantes visiteurs visitas посетител посетителей посетителя посетители посещаемость визит визитов визита визиты زوار",
    "bed": "beds 床 camas leitos lits коек койки койка أسرة سرير", "outpatient": "outpatients outpatient_visits patients пациентов посещений",
    "enrolled": "students enrollment enrolled 人 estudiantes alumnos estudantes alunos étudiants inscriptions студентов обучающихся учащихся طلاب",
    "student": "students learners estudiantes alumnos estudantes alunos étudiants студентов обучающихся учащихся طلاب",
    "office": "gross_floor_area gfa office* офис*", "leased": "net_lettable_area nla office* аренд* офис*",
    "line": "lines routes platforms линий маршрутов платформ путей", "international": "international_passengers international_traffic",
}


@dataclass(frozen=True)
class Kind:
    """A number, then up to three words of kinds between, then a unit; within 40 characters, where more is named, a word of that kind."""

    unit: str = ""
    between: str = ""
    more: str = ""
    label: str = ""
    percent: bool = False
    phrases: str = ""


#: The indicators.
KINDS = {
    "annual_passenger_throughput": Kind("passenger movement", "scale"), "passenger_throughput": Kind("passenger cruise", "scale"),
    "terminal_capacity": Kind("passenger", "scale"), "international_passenger_share": Kind("international", percent=True),
    "seat_count": Kind("seat", label="seat_label"), "capacity": Kind("holds"), "exhibition_area": Kind("sqm", more="exhibition"),
    "annual_events": Kind("event"), "peak_event_capacity": Kind("attendee"), "keys": Kind("room", "kind_of_room"), "rooms": Kind("room", "kind_of_room"),
    "meeting_ballroom_area": Kind("sqm", more="meeting"), "ballroom_capacity": Kind("guest", more="hall"), "annual_footfall": Kind("visit", "scale"),
    "beds": Kind("bed"), "outpatient_volume": Kind("outpatient"), "enrollment": Kind("enrolled"), "students": Kind("student"), "gla": Kind("sqm_short"),
    "office_gfa": Kind("sqm", more="office"), "office_nla": Kind("sqm", more="leased"), "daily_ridership": Kind("ride", "daily"), "ridership": Kind("ride", "scale"),
    "line_count": Kind("line"),
    "terminal_role": Kind(phrases="international gateway|main terminal|hub|terminal"),
    "main_venue_role": Kind(phrases="national stadium|main stadium|host venue|home stadium"),
    "hub_role": Kind(phrases="interchange|central station|transport hub|terminal"),
    "campus_center_role": Kind(phrases="main campus|flagship campus|central campus"),
    "indoor_coverage_deployment": Kind(phrases="indoor coverage|indoor network|indoor connectivity|in-building coverage|in-building network|distributed antenna system|das"),
    "das_deployment": Kind(phrases="distributed antenna system|das|small cell|prru|hrru"),
    "indoor_5g_upgrade": Kind(phrases="5g indoor|indoor 5g|5g coverage|5g network|5g deployment"),
}


def _any(kinds: str) -> str:
    """A pattern of the words of these kinds, the longest first."""
    words = sorted({w for k in kinds.split() for w in WORDS[k].split()}, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(re.escape(w.rstrip("*")).replace("_", r"\s*") for w in words) + ")"


_NUMBER = r"\d+(?:[  ]\d{3}(?!\d))*(?:[.,]\d+)*"


def _compiled(k: Kind) -> re.Pattern:
    if k.phrases:
        return re.compile("|".join(re.escape(p).replace(r"\ ", r"\s+") for p in k.phrases.split("|")), re.IGNORECASE)
    between = rf"(?:{_any(k.between)}\s+){{0,3}}" if k.between else ""
    more = rf".{{0,40}}?{_any(k.more)}" if k.more else ""
    out = rf"{_NUMBER}\s*{'%' if k.percent else ''}\s*{between}{_any(k.unit)}{more}"
    if k.label:
        out += rf"|{_any(k.label)}\s*[|:：–—-]?\s*{_NUMBER}"
    return re.compile(out, re.IGNORECASE)


PATTERNS = {name: _compiled(k) for name, k in KINDS.items()}


def found(text: str, names: list[str] | None = None, around: int = 140) -> list[dict]:
    """name, value (number and unit), context of every match of these indicators (all, if none are named), in their order."""
    out = []
    for name in names if names is not None else KINDS:
        for m in PATTERNS[name].finditer(text) if name in PATTERNS else ():
            out.append({"name": name, "value": m.group(), "context": text[max(0, m.start() - around) : m.end() + around]})
    return out
