"""Messages of the section scores."""

from docloom.functions import lexicon as lx
from docloom.operators import messages


def test_messages(spark):
    names = [s.lower() for s in lx.SECTIONS]
    row = {n: None for n in names} | {"header": "Ann\nLove1@X.com linkedin.com/in/ann", "summary": "Software Engineer with 8 years of experience", "education": "Bachelor, 2020", "skills": "- Python"}
    df = spark.createDataFrame([(1, *(row[n] for n in names)), (2, *(None for _ in names))], "doc_id long, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in messages.add_messages(df).collect()}
    one, none = got[1], got[2]
    assert one["evidence_contact"] == ["Email found: love1@x.com", "LinkedIn URL present."]
    assert one["issues_contact"] == ["Missing phone number.", "Email handle looks unprofessional."]
    assert one["issues_summary"] == ["Summary too short (7 words). Aim for 40–80."]
    assert one["evidence_summary"][0] == "States years of experience." and one["evidence_summary"][1].startswith("Targets a role: '")
    assert one["evidence_education"] == ["Degree mentioned.", "Graduation year present."] and one["issues_education"] == ["Institution not clearly listed."]
    assert one["evidence_length"] == ["Bullet points detected."] and "very short" in one["issues_length"][0]
    assert none["issues_summary"] == ["No professional summary section found."] and none["evidence_education"] == [] and none["evidence_summary"] == []
    assert none["issues_contact"] == ["No contact information detected."]
    assert set(df.columns) < set(messages.add_messages(df).columns) and messages.add_messages(df.limit(0)).count() == 0
