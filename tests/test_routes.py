"""The same answers when no lookup may be broadcast: shuffled joins, with and without hot keys."""

import pytest

from isoreach.operators import joins
from isoreach.registry import load
from tests.compare import connect, difference

NAMES = (
    "L01_cumulative", "L02_nearest", "J02_fallback", "J07_semi", "J08_anti", "L19_hospitals", "K01_point_in_zone",
    "K02_nearest_zone", "K04_within_10m", "K06_overlay_area", "K08_centroid",
)


# 4,000 bytes let the lookup rows of a few hot keys through, but hardly any whole lookup.
@pytest.mark.parametrize(
    ("name", "limit"),
    [(n, 4000) for n in NAMES] + [(n, 0) for n in ("L01_cumulative", "J02_fallback", "K01_point_in_zone", "K06_overlay_area")],
)
def test_without_broadcast(name, limit, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(joins, "SAMPLE_SHARE", 1.0)
    entry = load()[name]
    assert difference(entry.run(spark, sf_dir), connect(sf_dir), entry.sql) is None
