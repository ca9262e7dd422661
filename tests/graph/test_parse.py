import pytest

from arcweave import parse
from arcweave.parse import InvalidArgument, Swhid


@pytest.mark.parametrize("bad", ["", "swh:1:rev", "xxx:1:rev:" + "0" * 40, "swh:2:rev:" + "0" * 40, "swh:1:foo:" + "0" * 40, "swh:1:rev:0", "swh:1:rev:" + "g" * 40])
def test_bad_identifiers(bad):
    with pytest.raises(InvalidArgument):
        Swhid.parse(bad)


def test_identifiers():
    assert str(Swhid.parse("swh:1:rev:" + "A" * 40)) == "swh:1:rev:" + "a" * 40
    assert Swhid("cnt", "f") < Swhid("dir", "0")


def test_constraints():
    assert parse.node_types("*") is None and parse.node_types("cnt,cnt") == {"cnt"} and parse.node_types("snp,cnt,dir,ori,rel,rev") is None
    assert parse.show_types(frozenset({"rev", "cnt"})) == "cnt,rev" and parse.show_types(None) == "*"
    with pytest.raises(InvalidArgument):
        parse.node_types("cnt,*")
    assert parse.edges("*") is None and parse.edges("") == frozenset() and parse.edges("rev:dir") == {("rev", "dir")} and len(parse.edges("*:cnt")) == 6
    for bad in ("rev", "rev:xyz", "a:b:c"):
        with pytest.raises(InvalidArgument):
            parse.edges(bad)
    assert parse.reverse_edges("rev:dir,dir:*") == "dir:rev,*:dir" and parse.reverse_edges("*") == "*"
    with pytest.raises(InvalidArgument):
        parse.natural(-1, "x")


def test_steps():
    names = ["a", "b", "c", "d"]
    assert parse.steps("2-3", names) == ["b", "c"] and parse.steps("c-", names) == ["c", "d"] and parse.steps("a,4", names) == ["a", "d"] and parse.steps("*", names) == names
    with pytest.raises(InvalidArgument):
        parse.steps("9", names)
