"""Scalar rules on known cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatecount.functions import numbers as N
from gatecount.functions import text as X
from gatecount.functions import times as T

D, TS = dt.date, dt.datetime


@pytest.mark.parametrize(
    "title, key",
    [
        ("Odvážná Vaiana", "odvazna vaiana"),
        ("Odyssea DABING 3D", "odyssea"),
        ("Avatar IMAX 4DX", "avatar"),
        ("Film: druhý   díl -- tit.", "film druhy dil"),
        ("Příběh CZ dab", "pribeh"),
        ("", ""),
    ],
)
def test_normalize_title(one, title, key):
    assert one(X.normalize_title(F.col("t")), t=title) == key


def test_identity_prefers_the_original_and_is_never_empty(one):
    both = one(X.identity(F.col("t"), F.col("o")), t="Spider-Man: Zbrusu nový den", o="Spider-Man: Brand New Day")
    assert both["match_key"] == "spider man brand new day"
    assert both["local_key"] == "spider man zbrusu novy den"
    blank = one(X.identity(F.col("t"), F.col("o")), t=" Vlny ", o="  ")
    assert (blank["match_key"], blank["title"], blank["original_title"]) == ("vlny", "Vlny", None)
    odd = one(X.identity(F.col("t"), F.lit(None).cast("string")), t="???")
    assert odd["match_key"] == odd["local_key"] == "???"


def test_transliterations_share_the_tight_key(one):
    a = one(X.identity(F.col("t"), F.col("o")), t="x", o="Uma Musume Pretty Derby: Shinjidai no Tobira")
    b = one(X.identity(F.col("t"), F.col("o")), t="y", o="Umamusume Pretty Derby: Shinjidai no Tobira")
    assert a["match_key"] != b["match_key"] and a["tight_key"] == b["tight_key"]


@pytest.mark.parametrize(
    "tags, expected",
    [
        (["laser-barco", "atmos", "4dx", "3d", "comfort"], ["3D", "4DX"]),
        (["3D", "3d", " 3d "], ["3D"]),
        ([], []),
        (["imax", "SCREENX", "70MM"], ["70mm", "IMAX", "ScreenX"]),
    ],
)
def test_formats(one, tags, expected):
    assert one(X.normalize_formats(F.col("t")), t=tags) == expected


def test_versions(one):
    assert tuple(one(X.split_version(F.col("t")), t="Odyssea  TITULKY ")) == ("Odyssea", "titulky")
    assert tuple(one(X.split_version(F.col("t")), t="Dabing v praxi")) == ("Dabing v praxi", None)
    assert one(X.version_from_tags(F.col("t")), t=["4K", "Titulky", "Dabing"]) == "titulky"
    assert one(X.version_from_label(F.col("t")), t="orig") is None


@pytest.mark.parametrize(
    "wall, utc",
    [
        ("2026-07-31 12:00", TS(2026, 7, 31, 10)),
        ("2026-01-15T20:30", TS(2026, 1, 15, 19, 30)),
        ("2026-03-29T03:00", TS(2026, 3, 29, 1)),
        ("2026-03-29T02:30", TS(2026, 3, 29, 1, 30)),
        ("2026-10-25T20:00", TS(2026, 10, 25, 19)),
        ("2026-10-25T02:30:00", TS(2026, 10, 25, 1, 30)),
    ],
)
def test_local_to_utc(one, wall, utc):
    assert one(T.local_to_utc(T.parse_naive(F.col("w"))), w=wall) == utc


def test_unreadable_wall_clock_is_an_error(one):
    with pytest.raises(Exception, match="not a date and time of day"):
        one(T.parse_naive(F.col("w")), w="31.7.2026 12:00")


@pytest.mark.parametrize(
    "wall, day",
    [
        ("2026-08-01 04:59", D(2026, 7, 31)),
        ("2026-08-01 05:00", D(2026, 8, 1)),
        ("2026-01-01 01:00", D(2025, 12, 31)),
    ],
)
def test_business_day(one, wall, day):
    assert one(T.business_day(T.parse_naive(F.col("w"))), w=wall) == day


NOW = "2026-08-01 10:00:00"


@pytest.mark.parametrize(
    "start, look",
    [
        ("2026-08-01 11:30:00", TS(2026, 8, 1, 10, 10)),
        ("2026-08-01 16:00:00", TS(2026, 8, 1, 10, 30)),
        ("2026-08-02 16:00:00", TS(2026, 8, 1, 12)),
        ("2026-08-11 10:00:00", TS(2026, 8, 1, 22)),
        ("2026-08-01 10:08:00", TS(2026, 8, 1, 10, 3)),
        ("2026-08-01 10:02:00", TS(2026, 8, 1, 10)),
        ("2026-08-01 10:00:00", None),
        ("2026-08-01 09:00:00", None),
    ],
)
def test_next_look(one, start, look):
    assert one(T.next_look(F.col("s").cast("timestamp_ntz"), T.instant(NOW)), s=start) == look
    recheck = one(T.recheck_look(F.col("s").cast("timestamp_ntz"), T.instant(NOW)), s=start)
    assert recheck == (None if look is None else min(look, TS(2026, 8, 1, 10, 5)))


@pytest.mark.parametrize(
    "captured, grade",
    [(None, "missed"), ("17:50", "final"), ("17:45", "final"), ("17:44", "partial"), ("16:00", "partial"), ("18:05", "final")],
)
def test_confidence(one, captured, grade):
    at = F.lit(captured and f"2026-08-01 {captured}:00").cast("timestamp_ntz")
    assert one(T.settle_confidence(T.instant("2026-08-01 18:00:00"), at)) == grade


@pytest.mark.parametrize(
    "today, weekend",
    [
        (D(2026, 8, 3), D(2026, 7, 30)),
        (D(2026, 8, 5), D(2026, 7, 30)),
        (D(2026, 8, 8), D(2026, 7, 30)),
        (D(2026, 8, 2), D(2026, 7, 23)),
        (D(2026, 7, 31), D(2026, 7, 23)),
    ],
)
def test_expected_weekend(one, today, weekend):
    assert one(T.expected_weekend(F.col("d")), d=today) == weekend


@pytest.mark.parametrize(
    "capacity, ratio, sold, stale",
    [(158, 0.2405, 120, False), (158, 1.0, 0, False), (158, 0.0, 158, False), (100, 1.2, 0, False), (100, -0.2, 100, False), (101, 0.2405, 77, True)],
)
def test_seats_from_ratio(one, capacity, ratio, sold, stale):
    read = one(N.seats_from_ratio(F.col("c"), F.col("r")), c=capacity, r=ratio)
    assert (read["sold"], read["residual"] > 0.05) == (sold, stale)


@pytest.mark.parametrize(
    "text, number",
    [("256 291", 256291.0), ("3 868 681,5", 3868681.5), ("", 0.0), ("n/a", 0.0), ("-12", -12.0), ("1.2.3", 0.0)],
)
def test_clean_number(one, text, number):
    assert one(N.clean_number(F.col("t")), t=text) == number


def test_rounding_sends_halves_up(one):
    assert [one(N.round_half_up(F.col("x")), x=x) for x in (-0.5, 0.5, 1.5, 2.4)] == [0, 1, 2, 2]


def test_dates_from_reports(one):
    assert one(T.caption_date(F.col("t")), t="TOP 20 Víkend od: 23.07.2026 do 26.07.2026") == D(2026, 7, 23)
    assert one(T.printed_date(F.col("t")), t="02.08.2026") == D(2026, 8, 2)
    assert one(T.printed_date(F.col("t")), t="2.8.2026") is None
    assert one(T.serial_date(F.col("n")), n=45519.0) == D(2024, 8, 15)
    assert one(T.serial_date(F.col("n")), n=19999.0) is None


def test_entities(one):
    decode = X.decode_entities(F.col("t"))
    assert one(decode, t="Odyssea d&#225;l v&#xE1;lcuje &amp; spol.") == "Odyssea dál válcuje & spol."
    assert one(decode, t="&amp;lt;") == "&lt;"
    assert one(decode, t="&#128512;&#9999999;") == "😀&#9999999;"
    assert one(X.strip_markup(F.col("t")), t="<b>Sál</b>\n<i>4&nbsp;</i>") == "Sál 4"


def test_headlines(one):
    long = "Odyssea je film, který musíte vidět - Deník N"
    assert tuple(one(X.split_headline(F.col("t")), t=long)) == ("Odyssea je film, který musíte vidět", "Deník N")
    assert tuple(one(X.split_headline(F.col("t")), t="Krátký - titulek")) == ("Krátký - titulek", "")
    assert one(X.is_review(F.col("t")), t="Hodnocení filmu Odyssea") is True
    assert one(X.is_review(F.col("t")), t="Odyssea láme rekordy") is False


def test_origin(one):
    origin = X.origin_of(F.col("c"), F.col("t"), F.col("o"))
    assert one(origin, c=" cze ", t="a", o="b") == "cz"
    assert one(origin, c="USA", t="a", o="a") == "foreign"
    assert one(origin, c="", t="a", o="b") == "foreign"
    assert one(origin, c="", t="a", o="") == "cz"
