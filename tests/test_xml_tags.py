"""The row element of XML, found over whole files, with splits that fall anywhere."""

import pytest

from tablewise.sources.nested import read_xml, repeated_tag, xml_tags

BODY = "".join(f'<row id="{i}"\n  kind="a/b"><a>{i}</a><b><c>x</c></b><e/></row>' for i in range(60))
TEXT = f"<?xml version='1.0'?>\n<!-- 1 > 0 -->\n<top><meta>{''.join('<m>1</m>' for _ in range(3000))}</meta><rows>{BODY}</rows><rest><row2><a>1</a></row2><row2><a>1</a></row2></rest></top>"


@pytest.fixture
def file(tmp_path):
    (tmp_path / "a.xml").write_text(TEXT)
    return str(tmp_path / "a.xml")


def walked(text):
    """Plain walk over the same tags: name, kind, depth after."""
    import re

    depth, out = 0, []
    for record in text.split(">"):
        m = re.search(r"<(/?[A-Za-z_][^\s<>/]*)[^<]*$", record)
        if m:
            kind = -1 if m[1].startswith("/") else 0 if record.endswith("/") else 1
            depth += kind
            out.append((m[1].lstrip("/"), kind, depth))
    return out


@pytest.mark.parametrize("split", [1 << 20, 700])
def test_tags_and_row_element(spark, file, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, split)
        rows = sorted((r["__range"], r.pos, r.name, r.kind, r.depth) for r in xml_tags(spark, file).collect())
        assert (len({r[0] for r in rows}) > 20) == (split == 700)
        assert [r[2:] for r in rows] == walked(TEXT)
        assert repeated_tag(spark, file) == "row"
        assert read_xml(spark, file).count() == 60 and set(read_xml(spark, file).columns) >= {"@id", "@kind", "a", "b"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nothing_repeats(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<top><a><b>1</b></a></top>")
    assert repeated_tag(spark, str(tmp_path / "b.xml")) is None
    with pytest.raises(ValueError):
        read_xml(spark, str(tmp_path / "b.xml"))


def test_splits_tell_few_rows(spark, file):
    """What is shuffled for the row element are counts of a split, not its tags."""
    from tablewise.sources import nested

    facts = nested._tags_read(spark, file).mapInArrow(nested._split_facts, nested._FACTS).collect()
    assert len(facts) < 20 and {(r["above"], r["name"], r["n"]) for r in facts if r["what"] == "found"} >= {("rows", "row", 60), ("row", "b", 60), ("rest", "row2", 2)}


def test_files_of_a_year_are_bounded(spark, tmp_path, monkeypatch):
    """The orders of one year spread over files, each with its notes before and its end behind."""
    from queries import reading

    rows = spark.range(400).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "if(id % 50 = 3, null, 'F') as o_orderstatus", "'1-URGENT' as o_orderpriority", "timestamp'1995-03-01 00:00:00' as o_orderdate")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(reading, "XML_FILE", 100)
    monkeypatch.setattr(reading, "scratch", lambda spark: str(tmp_path / "made"))
    got = sorted((int(r["@key"]), r["status"], r["priority"], int(r["who"])) for r in reading.io08(spark, str(tmp_path)).collect())
    assert got == [(i, "F", "1-URGENT", i % 7) for i in range(400) if i % 50 != 3]
    texts = [p.read_text() for p in (tmp_path / "made" / "orders.xml").glob("year=1995/file=*/part-*")]
    assert len(texts) == 4 and all(t.startswith("<?xml") and t.endswith("</orders></export>\n") and t.count("<note>") == 2500 for t in texts)
