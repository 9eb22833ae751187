"""Kernels without a session."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.functions import cite, definitions, ids, quote, textnorm
from lexmill.sources import markup


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("§ 162(a)(1)(A)(i)(I)", ["/us/usc/t26/s162/a/1/A/i/I"]),
        ("See I.R.C. § 61.", ["/us/usc/t26/s61"]),
        ("26 USC 162", ["/us/usc/t26/s162"]),
        ("Code 162", []),
        ("§§ 162(a), 263(a), and 263A", ["/us/usc/t26/s162/a", "/us/usc/t26/s263/a", "/us/usc/t26/s263A"]),
        ("§ 162(a)–(c)", ["/us/usc/t26/s162/a", "/us/usc/t26/s162/b", "/us/usc/t26/s162/c"]),
        ("sections 704 through 706", ["/us/usc/t26/s704", "/us/usc/t26/s705", "/us/usc/t26/s706"]),
        ("§ 1400Z-2", ["/us/usc/t26/s1400Z-2"]),
        ("Treas. Reg. §1.263(a)-4(b)(1)", ["/us/cfr/t26/s1.263(a)-4/b/1"]),
        ("section 3 of the Tax Cuts and Jobs Act", []),
        ("Pub. L. 115-97, section 13101", []),
        ("`§ 162` and ```\n§ 61\n``` at https://x.org/§63", []),
        ("Rev. Rul. 2019-24", [None]),
        (None, []),
        ("", []),
    ],
)
def test_citations(text, found):
    assert [c["canonical_id"] for c in cite.extract_citations(text)] == found


def test_citation_details():
    c = cite.parse_citation("Temp. Treas. Reg. § 1.469-5T")
    assert (c["reg_kind"], c["display"]) == ("temporary", "Temp. Treas. Reg. § 1.469-5T")
    c = cite.extract_citations("See Welch v. Helvering, 290 U.S. 111, 115 (1933).")[0]
    assert (c["case_name"], c["reporter_cite"], c["pin_page"], c["case_year"]) == ("Welch v. Helvering", "290 U.S. 111", 115, 1933)
    long = cite.extract_citations("§§ 1-100")
    assert [x["section"] for x in long] == ["1", "100"] and all("not expanded" in x["warnings"][0] for x in long)
    with pytest.raises(ValueError, match="2 citations"):
        cite.parse_citation("§§ 1 and 2")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="§162(a)-–, and.Reg1T\n`", max_size=60))
def test_spans_are_offsets_into_the_text(text):
    for c in cite.extract_citations(text):
        assert text[c["start"] : c["end"]] == c["raw"]


@given(st.integers(1, 3999))
def test_roman_round_trip(n):
    assert ids.roman_to_int(ids.int_to_roman(n)) == n


@given(st.sampled_from(["irc", "reg"]), st.from_regex(r"[0-9]{1,4}[A-Z]?", fullmatch=True), st.lists(st.from_regex(r"[0-9A-Za-z]{1,3}", fullmatch=True), max_size=5))
def test_identifier_round_trip(source, section, path):
    i = ids.canonical_id(source, section, path)
    assert ids.split_id(i) == (source, section, path)
    assert ids.parent_id(i) == (ids.canonical_id(source, section, path[:-1]) if path else None)


@given(st.text(max_size=40))
def test_normalisation_keeps_offsets(text):
    n = textnorm.normalize_mapped(text)
    assert len(n.at) == len(n.text) and list(n.at) == sorted(n.at) and "  " not in n.text


def test_quotes():
    text = "It says “there shall be allowed as a deduction” in § 162(a). Then more.\n\n> gross income means all income\n\nSee § 61(a)."
    q = quote.extract_quotes(text)
    assert [x.kind for x in q] == ["curly", "blockquote"]
    spans = [(text.index(s), text.index(s) + len(s)) for s in ("§ 162(a)", "§ 61(a)")]
    assert quote.associate(q, spans, text) == {0: 0, 1: 1}
    source = "There shall be allowed as a deduction all the ordinary and necessary expenses"
    assert quote.score_quote("there shall be allowed . . . all the “ordinary”", source.replace("ordinary", '"ordinary"')) == 1.0
    assert quote.score_quote("[t]here shall be allowed", source) == 1.0
    assert 0.8 < quote.score_quote("there shall be alowed as a deductoin all the ordinary", source) < 1
    assert quote.score_quote("a quotation that is far longer than the source", "short") == 0.0
    assert quote.outcome(0.9, None, None) == "quote_close" and quote.outcome(0.5, 0.96, 1.0) == "wrong_pinpoint" and quote.outcome(None, None, None) == "quote_not_found"
    assert quote.word_diff("a b x", "a b c") == "a b ~~c~~ **x**"
    assert quote.longest_prefix("all the ordinary but rare", source) == 3


def test_definitions_and_relative_targets():
    text = 'For purposes of this section, the term “gross income” means all income. The term "widget" has the meaning given such term by section 7701.'
    found = definitions.extract_definitions(text)
    assert [(d["term_norm"], d["scope"]) for d in found] == [("gross income", "this section"), ("widget", "this section")]
    assert found[1]["by_reference"] == "section 7701."[:-1] or found[1]["by_reference"].startswith("section 7701")
    assert definitions.relative_targets("irc", "162", ["a", "1"], "this subsection and paragraph (2)") == [("/us/usc/t26/s162/a", "this subsection"), ("/us/usc/t26/s162/a/2", "paragraph (2)")]


STATUTE = b"""<uscDoc xmlns="http://xml.house.gov/schemas/uslm/1.0"><main><section identifier="/us/usc/t26/s61"><num value="61">61</num><heading>Gross income</heading>
<subsection identifier="/us/usc/t26/s61/a"><num value="a">(a)</num><chapeau>All income, including <ref href="/us/usc/t26/s62">62</ref>:</chapeau>
<paragraph identifier="/us/usc/t26/s61/a/1"><num value="1">(1)</num><content>wages,</content></paragraph><continuation>whatever source.</continuation></subsection>
<notes><note topic="effectiveDate"><heading>Effective</heading><p>applies to taxable years beginning after Dec. 31, 2017.</p></note></notes></section>
<section identifier="/us/usc/t26/s4 /us/usc/t26/s5" status="repealed"><num value="4">4</num></section></main></uscDoc>"""


def test_statute_parser():
    rows = markup.parse("statute", STATUTE)
    p = {r["id"]: r for r in rows if r["kind"] == "provision"}
    assert set(p) == {"/us/usc/t26/s61", "/us/usc/t26/s61/a", "/us/usc/t26/s61/a/1", "/us/usc/t26/s4", "/us/usc/t26/s5"}
    assert p["/us/usc/t26/s4"]["status"] == "repealed" and p["/us/usc/t26/s61"]["heading"] == "Gross income"
    full = p["/us/usc/t26/s61/a"]["full_text"]
    assert full.index("wages") < full.index("whatever source") and "taxable years" not in p["/us/usc/t26/s61"]["full_text"]
    notes = [r for r in rows if r["kind"] == "note"]
    assert [str(n["applies_after"]) for n in notes] == ["2017-12-31"]
    assert {r["to_id"] for r in rows if r["kind"] == "ref"} == {"/us/usc/t26/s62"}
    assert markup.parse("statute", b"<a><b>")[0]["kind"] == "corrupt"


REGULATION = b"""<DIV5><DIV8 N="1.61-1" TYPE="SECTION"><HEAD>\xc2\xa7 1.61-1   Gross income.</HEAD><P>(a) <I>General.</I> Gross income means income.</P>
<P>(1) One.</P><P>(i) Sub one.</P><P>(ii) Sub two.</P><P>More of two.</P><P>(2)(i) Deep.</P><P>(b) Other.</P><CITA>[T.D. 6272, Nov. 25, 1957]</CITA></DIV8></DIV5>"""


def test_regulation_parser():
    rows = markup.parse("regulation", REGULATION)
    p = {tuple(r["path"]): r for r in rows if r["kind"] == "provision"}
    assert set(p) == {(), ("a",), ("a", "1"), ("a", "1", "i"), ("a", "1", "ii"), ("a", "2"), ("a", "2", "i"), ("b",)}
    assert p["a", "1", "ii"]["text"] == "Sub two. More of two." and p["a",]["heading"] == "General"
    assert str(rows[-1]["applies_after"]) == "1957-11-25"
    assert markup.assign_level("i", False, [(1, "h")]) == 1 and markup.assign_level("v", False, [(1, "a"), (2, "1"), (3, "iv")]) == 3


def test_bulletin_and_rates():
    html = b'<div class="article"><h2 class="title">Rev. Rul. 2024-3</h2><p>This ruling supersedes Rev. Rul. 2020-1.<p>Body</div><script>x</script>'
    rows = markup.parse("bulletin", html)
    assert [(r["kind"], r["id"], r["to_id"], r["topic"]) for r in rows] == [("guidance", "rev-rul-2024-3", None, "Rev. Rul."), ("relation", "rev-rul-2024-3", "rev-rul-2020-1", "supersedes")]
    table = b'<p class="title">Rev. Rul. 2024-3 TABLE 3 Rates for January 2024</p><table><tr><td>Long-term tax-exempt rate for ownership changes</td><td>3.81%</td></tr><tr><td>Adjusted federal long-term rate</td><td>3.67%</td></tr></table>'
    assert [(str(m), a, b) for m, a, b in markup.rate_rows(table)] == [("2024-01-01", 3.81, 3.67)]


def _read(reader, text):
    return [(text[x.start : x.end], x.display) for x in reader(text)]


def test_readers_of_cases():
    from lexmill.functions.readers import cases

    got = list(cases("Compare Alder Mills v. Brook of the Vale, 12 F. Supp. 3d 400, 405-07 (D. Me. 1991); 3 U.S.T.C. 9 and Versus Oak v. Elm, 9 B.T.A. 1, 54 S. Ct. 8"))
    assert [(x.fields["case_name"], x.fields["reporter_cite"], x.fields["pin_page"], x.fields["case_year"]) for x in got] == [
        ("Alder Mills v. Brook of the Vale", "12 F. Supp. 3d 400", 405, 1991), (None, "3 U.S.T.C. 9", None, None), ("Oak v. Elm", "9 B.T.A. 1", None, None), (None, "54 S. Ct. 8", None, None),
    ]
    memo = list(cases("In re Ash, T.C. Memo. 2011-7"))
    assert [(x.fields["case_year"], x.display) for x in memo] == [(2011, "T.C. Memo. 2011-7")]
    assert not list(cases("12 Angry Men, 3 F. and 4 others")) and not list(cases(""))


def test_readers_of_guidance_and_commentary():
    from lexmill.functions.readers import commentary, guidance, of_instrument, of_public_law

    assert _read(guidance, "Rev.Rul. 2004–7, Ann. 2001-3, Ann 2001-3, xNotice 2004-7, ILM 20051, T. D. 9100, PLR 99123 and 2004-12 I. R. B. 600") == [
        ("Rev.Rul. 2004–7", "Rev. Rul. 2004-7"), ("Ann. 2001-3", "Ann. 2001-3"), ("ILM 20051", "ILM 20051"), ("T. D. 9100", "T.D. 9100"), ("2004-12 I. R. B. 600", "2004-12 I.R.B. 600"),
    ]
    assert [x for x, _ in _read(commentary, "44 Maple L. Rev. 7; McKee and Nelson, in ¶ 3.02; a Treatise; Portfolio No. 12; 1 a L. Rev. 2; Saltzman. § 4")] == [
        "44 Maple L. Rev. 7", "McKee and Nelson, in ¶ 3.02", "Treatise", "Portfolio No. 12",
    ]
    assert of_public_law("as in Pub. L. No. 99-514, ") and of_public_law("P.L. 94") and not of_public_law("the plain 12 ") and not of_public_law("")
    assert of_instrument(" of the Harbor and Canals Act, which") and of_instrument(" of this Lease") and not of_instrument(" of the Code") and not of_instrument(" of the old Act")


def test_relative_references_in_any_case():
    found = definitions.relative_targets("irc", "9", ["b", "2"], "This Subsection, Paragraph (xxvii) and paragraph (xxxviii)")
    assert found == [("/us/usc/t26/s9/b", "This Subsection"), ("/us/usc/t26/s9/b/xxvii", "Paragraph (xxvii)")]
