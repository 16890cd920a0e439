"""Promotions of several promoters at one moment."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel

from fleetgauge.plans import models
from fleetgauge.sources import registry


def test_promoters_never_share_a_number(spark, tmp_path):
    root = str(tmp_path / "models")
    for version in ("v001", "v002"):
        registry.save_model(PipelineModel([models.assembler()]), root, version)
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda k: registry.promote(spark, root, f"v00{1 + k % 2}"), range(18)))
    assert len(set(numbers)) == 18
    log = {r.seq: r.version for r in registry.promotions(spark, root).collect()}
    assert sorted(log) == sorted(numbers) and log[max(log)] == registry.active_version(spark, root)


def test_reserved_versions_are_given_once(spark, tmp_path):
    root = str(tmp_path / "models")
    registry.save_model(PipelineModel([models.assembler()]), root, "v001")
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(lambda _: registry.reserve_version(spark, root), range(12)))
    assert sorted(names) == [f"v{k:03d}" for k in range(2, 14)]
    assert registry.next_version(spark, root) == "v002"  # none of them is saved yet
