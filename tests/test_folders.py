from types import SimpleNamespace

import pytest

from proseline.sources import folders


def session(master, named=None, given=None):
    state = {"dir": given}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda x: state.update(dir=x),
        getConf=lambda: {"spark.checkpoint.dir": named} if named else {},
    )
    return SimpleNamespace(sparkContext=context)


def test_the_sessions_folder_is_used(tmp_path):
    assert folders.shared_folder(session("spark://host:7077", given="/shared/own")) == "/shared/own"
    assert folders.shared_folder(session("yarn", named="/shared")) == "/shared"
    assert folders.shared_folder(session("local[8]", named=str(tmp_path))) == str(tmp_path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(session(master))


def test_a_local_session_gets_a_temporary_folder():
    assert "proseline-" in folders.shared_folder(session("local[2]"))
