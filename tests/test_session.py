from pathlib import Path
from types import SimpleNamespace

import pytest

from pitlake.session import clear, local_path, materialised, scratch, shared_dir


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(s)
    kept = {}
    s = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d, set=kept.__setitem__), sparkContext=SimpleNamespace(master="local[4]"))
    assert shared_dir(s).startswith("file:///") and kept


def test_tables_are_deleted(spark):
    clear(spark)
    df, other = materialised(spark.range(5), "kept"), scratch(spark, "unwritten")
    path = Path(local_path(df.inputFiles()[0].replace("file:///", "file:////"))).parent
    assert df.count() == 5 and path.exists() and other.startswith(shared_dir(spark))
    assert clear(spark) == 2 and not path.exists() and clear(spark) == 0
