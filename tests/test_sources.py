import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from rosterloom.sources import base, directory, federal, mandates, register, workbook

D = dt.date


def day(text="2022-06-01"):
    return F.lit(text).cast("date")


def strings(spark, rows):
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def seat(number, joined, left="1753-01-01T00:00:00", **x):
    return dict(PersonNumber=number, Active="true", FirstName="A", LastName=f"B{number}", CouncilAbbreviation="NR", CantonAbbreviation="BE", ParlGroupAbbreviation="G", PartyAbbreviation="P", BirthPlace_City="Town", BirthPlace_Canton="BE", DateJoining=joined, DateLeaving=left, DateOfBirth=None, Citizenship="Aa (BE), Bb (ZH)", NumberOfChildren="0") | x


def test_federal(spark):
    rows = strings(spark, [seat("1", "2011-12-05T00:00:00"), seat("1", "2015-11-30T00:00:00"), seat(None, "2015-11-30"), seat("2", "1753-01-01T00:00:00", Active="false"), seat("3", "2019-12-02", CouncilAbbreviation="CN"), seat("4", "2019-12-02")]).coalesce(1)
    got = {r["person_key"]: r for r in federal.members(rows, ["nr "]).collect()}
    assert set(got) == {"1", "4"} and got["1"]["date_joining"] == D(2015, 11, 30) and got["1"]["date_leaving"] is None
    assert got["1"]["place_of_birth"] == "Town (BE)" and got["1"]["places_of_origin"] == ["Aa (BE)", "Bb (ZH)"]
    history = strings(spark, [seat("1", "2011-12-05", "2015-11-29"), seat("1", "2011-12-05", "2015-11-29"), seat("1", "2015-11-30", "2019-12-01"), seat("1", "2019-12-02"), seat("1", "2003-01-01", "2007-01-01")]).coalesce(1)
    periods = strings(spark, [dict(LegislativePeriodNumber="51", LegislativePeriodName="51st", StartDate=None, EndDate=None), dict(LegislativePeriodNumber="51", LegislativePeriodName="51e", StartDate="2019-12-02", EndDate="1753-01-01")]).coalesce(1)
    whole = federal.read(rows, history, periods, ["NR"])
    assert [(r["start"], r["end"]) for r in whole.tenures.collect()] == [(D(2011, 12, 5), None)]
    assert {r["person_key"]: r["tenure_start"] for r in whole.members.collect()} == {"1": D(2011, 12, 5), "4": None}
    assert [tuple(r) for r in whole.periods.collect()] == [(51, "51e", D(2019, 12, 2), None)]
    assert whole.segments.count() == 4


def test_directory(spark):
    groups = spark.createDataFrame([(7, "Upper  council", None), (8, "Upper council committee", "x"), (9, "other", "UPPER COUNCIL")], "id long, name_de string, title_de string").coalesce(1)
    ids = directory.group_ids(groups, {"KR": "Upper Council"})
    assert ids == {"KR": 7}
    m = spark.createDataFrame([(1, 7, "Member", "2019-05-06", None), (1, 7, "Member", "2015-05-04", "2019-05-05"), (2, 7, "Guest", "2019-05-06", None), (3, 7, None, "2023-01-01", None), (4, 7, "Member", "2020-01-01", "2030-01-01"), (5, 7, "member ", "2020-01-01", ""), (6, 8, "Member", "2020-01-01", None)], "person_id long, group_id long, role_name_de string, begin_date string, end_date string").coalesce(1)
    p = spark.createDataFrame([(1, "Ann", "Lee", None, " North  side", "Q1", "a; b,c"), (9, None, None, "Bo van Ek", None, "Q1", None)], "id long, firstname string, lastname string, fullname string, electoral_district_de string, wikidata_id string, occupation_de string").coalesce(1)
    got = {r["person_key"]: r for r in directory.members(m, p, ids, ["Member"], day()).collect()}
    assert set(got) == {"1", "5"} and got["1"]["constituency"] == "North side" and got["1"]["occupations"] == ["a", "b,c"] and got["5"]["full_name"] is None
    assert {r["person_key"]: r["start"] for r in directory.tenures(m, ids).collect()}["1"] == D(2019, 5, 6)
    assert [tuple(r) for r in base.link_conflicts(p, "id", "wikidata_id", F.lit("KR")).collect()] == [("KR", "Q1", [1, 9])]
    assert directory.spans(m, p, ids).count() == 0
    only = directory.spans(m, p.filter("id = 1"), ids).first()
    assert (only["qid"], only["start"], only["end"], only["person_ids"]) == ("Q1", D(2015, 5, 4), None, [1])


def test_register(spark):
    seats = strings(spark, [dict(id_einsitz_new="e1", id_person_new="p1", rat="Kantonsrat", datum_eintritt_tag="6", datum_eintritt_monat="5", datum_eintritt_jahr="2019", wahlkreis="I  x"), dict(id_einsitz_new="e2", id_person_new="p2", rat="Kantonsrat", datum_eintritt_tag="", datum_eintritt_monat="", datum_eintritt_jahr="2019"), dict(id_einsitz_new="e3", id_person_new="p3", rat="Kantonsrat", datum_eintritt_jahr="2001", datum_austritt_jahr="2005"), dict(id_einsitz_new="e4", id_person_new="p4", rat="Kantonsratspräsidium")])
    seats = strings(spark, [r.asDict() | {"datum_austritt_tag": None, "datum_austritt_monat": None} for r in seats.collect()]).coalesce(1)
    persons = strings(spark, [dict(id_person_new="p1", vorname="A", nachname="B", beruf="x", datum_geburt_tag="30", datum_geburt_monat="2", datum_geburt_jahr="1970")])
    parties = strings(spark, [dict(id_einsitz_new="e1", parteibezeichnung="P", fraktion="G"), dict(id_einsitz_new="e1", parteibezeichnung="", fraktion="H")]).coalesce(1)
    got = {r["person_key"]: r for r in register.members(seats, persons, parties, "Kantonsrat", "KR", day()).collect()}
    assert set(got) == {"p1", "p2"} and got["p1"]["party"] == "P" and got["p1"]["parl_group"] == "H" and got["p1"]["birth_date"] is None and got["p1"]["constituency"] == "I x"
    assert got["p2"]["date_joining"] is None


def test_mandates(spark):
    m = strings(spark, [dict(kontaktguid="g1", gremium="The  Council", funktion="Member", dauer_start="20180501", dauer_end="9999-12-31", name="Own", vorname="Ann", partei="P"), dict(kontaktguid="g1", gremium="the council", funktion="Member", dauer_start="2014-05-01", dauer_end="2022-06-01", name="", vorname="", partei=""), dict(kontaktguid="g2", gremium="The Council", funktion="Member", dauer_start="2014", dauer_end=None)]).coalesce(1)
    p = strings(spark, [dict(obj_guid="g1", name="Old", vorname="Ann", partei="Q", namevorname="Old Ann", jahrgang="1970", beruf="x", fraktion="F", homepageprivat="")])
    (row,) = mandates.members(m, p, {"GR": "The Council"}, [], day()).collect()
    assert (row["person_key"], row["date_joining"], row["full_name"], row["party"], row["birth_date"]) == ("g1", D(2014, 5, 1), "Ann Old", "Q", None)
    assert [(r["start"], r["end"]) for r in mandates.tenures(m, {"GR": "The Council"}).collect()] == [(D(2018, 5, 1), None)]


def book(rows):
    out = io.BytesIO()
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Personen" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    grid = [["Title"], ["", ""], ["Id Person", "Name", "", "Name"], ["1", "A", "x", "B"], ["", "", "", ""], ["2", "C"]]
    want = (["id_person", "name", "column_3", "name_4"], [{"id_person": "1", "name": "A", "column_3": "x", "name_4": "B"}, {"id_person": "2", "name": "C", "column_3": "", "name_4": ""}])
    kind, sheets, error = workbook.parse(book(grid))
    assert (kind, sheets["Personen"], error) == (workbook.OOXML, want, None)
    assert workbook.parse(b"\xef\xbb\xbfa;b,c\n1;2\n")[1][""] == (["a", "b,c"], [{"a": "1", "b,c": "2"}])
    assert workbook.parse(b"<html><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2<b>3</b></td></tr></table><table><tr><td>x</td></tr></table>")[1][""][1] == [{"a": "1", "b": "23"}]
    assert workbook.parse(b"PK\x03\x04broken")[2] and workbook.parse(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")[0] == workbook.BIFF and workbook.parse(b"hello")[0] == workbook.UNKNOWN
    (tmp_path / "a.xlsx").write_bytes(book(grid))
    rows = workbook.read(spark, str(tmp_path))
    assert [(r["id_person"], r["name"]) for r in workbook.sheet(rows, "personen", ["id_person", "name"]).orderBy("ord").collect()] == [("1", "A"), ("2", "C")]


def test_xml_hits(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<R numHits="2"><Hit Guid="g1"><M><Name>A</Name><Year>1970</Year></M></Hit><Hit Guid="g2"><M><Name>B</Name></M></Hit></R>')
    got = workbook.flat(workbook.hits(spark, str(tmp_path), "_Guid string, M struct<Name:string,Year:string>")).orderBy("guid").collect()
    assert [tuple(r) for r in got] == [("g1", "A", "1970"), ("g2", "B", None)]


def test_names_formats_and_broken_books():
    assert workbook.named([["Tel. (privat)", "Name  2"], ["1", "2"]])[0] == ["tel._(privat)", "name_2"]
    assert workbook.sniff(b"<!-- export --><div><table><tr>") == workbook.HTML and workbook.sniff(b"", "text/html") == workbook.UNKNOWN
    assert workbook.parse(b"a;b\n")[2] == "delimited without data rows"
    whole = book([["A", "B"], ["1", "2"]])

    def without(*parts):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                if name not in parts:
                    new.writestr(name, old.read(name))
        return workbook.parse(out.getvalue())

    for parts in (("xl/workbook.xml",), ("xl/_rels/workbook.xml.rels",)):
        kind, sheets, error = without(*parts)
        assert error is None and [rows for _, rows in sheets.values()][0] == [{"a": "1", "b": "2"}]
    sheet = next(n for n in zipfile.ZipFile(io.BytesIO(whole)).namelist() if "worksheets" in n)
    assert without(sheet)[2] == "ooxml without data rows"


def test_columns_across_sheets():
    headers = {"Personen": ["id_person", "nachname"], "Einsitze": ["id_einsitz", "datum_eintritt_jahr", "person_beruf"]}
    assert workbook.find_column(headers, ["datum_eintritt_jahr", "jahr"]) == [("Einsitze", "datum_eintritt_jahr")]
    assert workbook.find_column(headers, ["beruf"]) == [("Einsitze", "person_beruf")]
    assert workbook.find_column(headers, ["gnd"]) == []


def test_a_long_sheet_comes_in_batches(spark, tmp_path):
    import tracemalloc

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>s{k}</t></si>" for k in range(1000)) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c><v>id</v></c><c><v>name</v></c></row>" + "".join(f"<row><c><v>{k}</v></c><c t='s'><v>{k % 1000 if k % 7 else 99999}</v></c></row>" for k in range(60_000)) + "</sheetData></worksheet>")
    tracemalloc.start()
    assert sum(1 for r in workbook.records(out.getvalue()) if r[3]) == 60_000 and tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    (tmp_path / "long.xlsx").write_bytes(out.getvalue())
    (tmp_path / "broken.xlsx").write_bytes(out.getvalue()[:5000])
    rows = workbook.read(spark, str(tmp_path))
    assert rows.filter("error IS NULL").count() == 60_000 and rows.filter("error IS NOT NULL").count() == 1
    assert {r["row"]: r["values"]["name"] for r in rows.filter("row IN (7, 8)").collect()} == {7: "99999", 8: "s8"}
