"""Items whose windows have few distinct terms."""

from threadloom.llm.leakage import Detector


def test_repetitive_item():
    item = "alpha beta " * 10
    found = Detector([(1, item, "en"), (2, " ".join(f"w{k}" for k in range(30)), "en")])
    edited = item.split()
    edited[4], edited[9], edited[14] = "x", "y", "z"
    assert found.leaks("before " + item + " after") == [1]
    assert found.leaks(" ".join(edited)) == [1]
    assert found.leaks("alpha beta gamma delta") == [] and found.leaks(" ".join(f"w{k}" for k in range(5, 25))) == [2]
