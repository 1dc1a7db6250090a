from types import SimpleNamespace

import pytest

from tracefold import shared


def session(master, named=""):
    held = {}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held.get("dir"), setCheckpointDir=lambda d: held.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master))
        assert shared.shared_folder(session(master, "s3a://bucket/cp")) == "s3a://bucket/cp"
    for master in ("local", "local[4]"):
        own = session(master)
        assert shared.shared_folder(own) == shared.shared_folder(own)
