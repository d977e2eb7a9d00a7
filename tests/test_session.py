import pytest

from wardlake import session


class Fake:
    """A session without a shared folder."""

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master})()
        self.conf = type("F", (), {"get": lambda s, k, d=None: d, "set": lambda s, k, v: None})()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake(master))


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_may_use_its_own(master):
    assert session.shared_dir(Fake(master))
