import math

import pytest
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.functions import stats, texts
from clickweave.operators.timeframe import (
    DAY_MS, Timeframe, deploy_windows, preset_timeframe, timeframe_from_params,
)


def values(df, expr):
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_device_type(table):
    df = table(
        "ua string, hint string",
        ("iPhone Mobile", None), ("iPad", ""), ("Android Tablet", None), ("Tablet Mobile", None),
        ("X11", None), ("", None), (None, None), (None, "tv"),
    )
    assert values(df, S.device_type(F.col("ua"), F.col("hint"))) == [
        "mobile", "tablet", "tablet", "mobile", "desktop", "unknown", "unknown", "tv",
    ]


def test_client_ip(table):
    df = table("f string, ip string", (" 1.1.1.1 , 2.2.2.2", None), ("", "3.3.3.3"), (None, None), (" ,x", ""))
    assert values(df, S.client_ip(F.col("f"), F.col("ip"))) == ["1.1.1.1", "3.3.3.3", "unknown", "unknown"]


def test_number_prefixes(table):
    df = table("t string", ("12abc",), (" -7",), ("abc",), ("",), (None,), ("3.9",), ("1e3x",), (".5",))
    assert values(df, S.parse_int(F.col("t"))) == [12, -7, None, None, None, 3, 1, None]
    assert values(df, S.parse_float(F.col("t"))) == [12.0, -7.0, None, None, None, 3.9, 1000.0, 0.5]


def test_missing_numbers(table):
    df = table("x double", (0.0,), (math.nan,), (None,), (2.0,))
    assert values(df, S.number_or_null(F.col("x"))) == [None, None, None, 2.0]
    assert values(df, S.number_or_null(F.col("x"), zero_is_null=False)) == [0.0, None, None, 2.0]


def test_percentages(table):
    df = table("n long, d long", (1, 3), (2, 3), (0, 5), (1, 0), (201, 20000))
    assert values(df, S.pct(F.col("n"), F.col("d"))) == [33.33, 66.67, 0.0, None, 1.01]
    df = table("c double, p double", (100.0, 80.0), (5.0, 0.0), (20.0, 25.0), (None, 4.0))
    assert values(df, S.pct_change(F.col("c"), F.col("p"))) == [25.0, 0.0, -20.0, None]
    assert values(df, S.point_change(F.col("c"), F.col("p"))) == [20.0, 5.0, -5.0, -4.0]


def test_times_and_labels(table):
    df = table("s long, x double", (1_705_276_800, 12.25), (0, 0.05))
    assert values(df, S.iso_time(F.col("s"))) == ["2024-01-15T00:00:00.000Z", "1970-01-01T00:00:00.000Z"]
    assert values(df, S.percent_label(F.col("x"))) == ["12.3%", "0.1%"]
    assert values(df, S.seconds_label(F.col("x"))) == ["12s", "0s"]
    assert values(df, S.event_time(F.col("s"), F.lit(9))) == [1_705_276_800, 9]


def test_scroll(table):
    df = table("p int", *[(p,) for p in (0, 24, 25, 49, 50, 74, 75, 99, 100, 101)])
    assert values(df, S.scroll_bucket(F.col("p"))) == [None, None, 25, 25, 50, 50, 75, 75, 100, None]
    df = table("t double, h double", (1.0, 200.0), (1.0, 0.0), (99.9, 100.0))
    assert values(df, S.scroll_percent(F.col("t"), F.col("h"))) == [1, None, 100]


def test_timeframes():
    assert not Timeframe(0, float("nan")).bounded
    assert timeframe_from_params("12x", "abc") == Timeframe(12, None)
    assert preset_timeframe("7d", 10 * DAY_MS) == Timeframe(3 * DAY_MS, 10 * DAY_MS)
    assert not preset_timeframe("all", 5).bounded
    current, previous = deploy_windows(172_800)
    assert (current.lo, current.hi, previous.lo, previous.hi) == (DAY_MS, 2 * DAY_MS, 0 or None, DAY_MS)


def test_z_scores(table):
    df = table("l double", (0.8,), (0.95,), (0.999,), (0.5,))
    assert values(df, stats.z_score(F.col("l"))) == [1.28, 1.96, 3.291, 1.96]


def test_erf_and_standard_error(table):
    xs = [-3.0, -0.5, 0.1, 0.5, 1.0, 2.5]
    got = values(table("x double", *[(x,) for x in xs]), stats.erf(F.col("x")))
    assert got == pytest.approx([math.erf(x) for x in xs], abs=2e-7)
    assert got[1] == pytest.approx(-got[3])
    df = table("p double, n long", (0.5, 100), (0.5, 0))
    assert values(df, stats.standard_error(F.col("p"), F.col("n"))) == [0.05, None]


def test_ab_confidence(table):
    df = table(
        "a long, na long, b long, nb long",
        (0, 0, 1, 10), (5, 10, 5, 10), (10, 10, 0, 10), (120, 1000, 100, 1000), (100, 1000, 120, 1000),
    )
    got = values(df, stats.ab_confidence(*[F.col(c) for c in ("a", "na", "b", "nb")]))
    assert got[:3] == [0.0, 0.0, 0.9999]
    se = math.sqrt(0.12 * 0.88 / 1000 + 0.1 * 0.9 / 1000)
    assert got[3] == pytest.approx((1 + math.erf(0.02 / se / math.sqrt(2))) / 2, abs=1e-6)
    assert got[3] == pytest.approx(got[4])


def test_sample_size(table):
    df = table("base double, lift double", (0.1, 0.2), (0.1, 0.0))
    mean, diff = 0.11, 0.02
    want = math.ceil(2 * mean * (1 - mean) * ((1.96 + 1.28) / diff) ** 2)
    assert values(df, stats.required_sample_size(F.col("base"), F.col("lift"))) == [want, None]


def test_paths_and_imports(table):
    df = table(
        "p string, t string",
        ("src/app/x/page.tsx", "./view"), ("src/app/x/page.tsx", "../../lib/m.ts"),
        ("src/app/x/page.tsx", "../y"), ("page.tsx", "./a/b"), ("a/b.ts", "../../../c"),
    )
    assert values(df, texts.resolve_import(F.col("p"), F.col("t"))) == [
        "src/app/x/view.tsx", "src/lib/m.ts", "src/app/y.tsx", "a/b.tsx", "c.tsx",
    ]
    code = """import A from 'react';\nimport B from "./b";\nimport { C,\n D } from '../c';\nimport * as E from './e';"""
    assert values(table("c string", (code,)), texts.relative_imports(F.col("c"))) == [["./b", "../c"]]
    df = table("p string", ("src/app/a.tsx",), ("src/app/_x.tsx",), ("app/a.tsx",), ("x/routes/y",), ("src/lib/a",))
    assert values(df, texts.is_page_path(F.col("p"))) == [True, False, False, True, False]


def test_cleaning(table):
    df = table("t string", ('  Sure:\n```json\n{"a": {"b": 1}}\n``` done',), ("no object",), ("{1}",))
    assert values(df, texts.clean_reply(F.col("t"))) == ['{"a": {"b": 1}}', "no object", "{1}"]
    df = table("t string", ("Here:\n```tsx\nimport x\ny\n```\n",), ("```\n```",), ("   ",), ("plain text",))
    assert values(df, texts.clean_code(F.col("t"))) == ["import x\ny", None, None, "plain text"]
