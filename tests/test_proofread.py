"""Drafts and profiles with every kind of fault."""

from lakewright.operators import proofread


def test_profiles(spark):
    fields = spark.createDataFrame(
        [("p", "org", "USCC", "91350100M000100Y43"), ("p", "org", "credit_code2", "91350100M000100Y44"), ("p", "me", "ID_card", "110105194912310021"), ("p", "me", "myPhone", "12345"), ("p", "me", "phone_of_idcard", "11010519491231002X"),
         ("p", "me", "x", " 　 "), ("p", "me", "y", None), ("q", "me", "mobile", " 13800138000 ")], "profile string, category string, key string, value string")
    attachments = spark.createDataFrame([("p", "a", "/a"), ("p", "b", "/b"), ("q", "c", "/c")], "profile string, key string, path string")
    files = spark.createDataFrame([("/a", 3 * 1024 + 1023), ("/c", 4 * 1024)], "path string, size long")
    issues = proofread.profile_issues(fields, attachments, files, 3)
    want = [("p", "attachments.b", "error", "no such file"), ("p", "me.ID_card", "error", "identity number"), ("p", "me.myPhone", "warning", "phone number"), ("p", "me.x", "warning", "empty"), ("p", "me.y", "warning", "empty"), ("p", "org.credit_code2", "error", "organisation code"), ("q", "attachments.c", "warning", "large file")]
    assert sorted(map(tuple, issues.collect())) == want
    assert proofread.profile_issues(fields, attachments, files, 0).where("rule = 'large file'").count() == 0
    checked = fields.select("profile").unionByName(attachments.select("profile"))
    assert sorted(map(tuple, proofread.report(issues, checked, "profile").collect())) == [("p", False, 9, 3, 3), ("q", True, 2, 0, 1)]


def test_drafts(spark):
    args = spark.createDataFrame([("d", "credit", "91350100M000100Y44"), ("d", "creditIdcard", "x"), ("d", "id-card", "11010519491231002X"), ("d", "uscc", None), ("e", "name", "n")], "draft string, key string, value string")
    missing = spark.createDataFrame([("d", "mail"), ("f", "mail")], "draft string, field string")
    issues = proofread.draft_issues(args, missing)
    assert sorted(map(tuple, issues.collect())) == [("d", "credit", "error", "organisation code"), ("d", "creditIdcard", "error", "identity number"), ("d", "creditIdcard", "error", "organisation code"), ("d", "mail", "error", "missing"), ("f", "mail", "error", "missing")]
    assert sorted(map(tuple, proofread.report(issues, args, "draft").collect())) == [("d", False, 4, 4, 0), ("e", True, 1, 0, 0), ("f", False, 0, 1, 0)]
