import os

from sievewright.llm import common
from sievewright.llm.wordhash import local_path


def test_shared_folders_are_dropped(spark):
    df = common.cut(spark, spark.range(3), "numbers")
    place = local_path(common._made[-1])
    assert df.count() == 3 and os.path.isdir(place)
    common.drop_shared(spark)
    assert not os.path.exists(place) and not common._made
