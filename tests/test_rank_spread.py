import os

import pytest

from proseline import catalog
from proseline.operators import resample

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_rank_spread_draws_500_replicates(spark, monkeypatch):
    seen = []

    def spread(sums, human, draws, *more, **named):
        seen.append(draws.select("rep").distinct().count())
        return sums

    monkeypatch.setattr(resample, "rank_spread", spread)
    catalog.QUERIES["rank_spread"](spark, SF)
    assert seen == [500]
