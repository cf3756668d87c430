"""Equal facts and excerpts on literal cases."""

from gazetta.operators import evidence as V


def test_facts_equivalent(spark):
    cases = [
        ("주관연구개발기관은 매출액 10억원 이상", "주관기관 매출액 10억원 이상", True),
        ("매출액 10억원 이상", "매출액 10억원 초과", False),
        ("매출액 1,000.50만원", "매출 1000.5만원", True),
        ("주관기관 매출액 10억원", "공동기관 매출액 10억원", False),
        ("중소기업 또는 업력 7년 이내", "업력 7년 이하 혹은 중소기업", True),
        ("매출 5억원 이상 또는 업력 3년 이상", "매출 3억원 이상 또는 업력 5년 이상", False),
        ("특허는 인정되지 않는다", "특허 불인정", True),
        ("특허는 제외", "인증은 제외", False),
        ("3명, 5건", "5건, 3명", False),
        ("「중소기업기본법」 제2조에 따른 중소기업", "중소기업", False),
        ("중소기업", "「중소기업기본법」 제2조에 따른 중소기업", True),
        ("등급 B+", "등급 B-", False),
        ("A=1", "A1", False),
        (None, "", True),
        (None, "3명", False),
        ("３명 이상", "3명 이상", True),
        ("① 특허 없는 기업", "1 특허 없음 기업", True),
        # laws: the text may leave out, with or without marks, but not add or change
        ("상생협력법 제4조에 따른 중견기업", "중견기업", False),
        ("상생협력법 제4조에 따른 중견기업", "「상생협력법」 제4조에 따른 중견기업", True),
        ("상생협력법에 따른 중견기업", "「상생협력법」 제4조에 따른 중견기업", True),
        ("상생협력법 제5조에 따른 중견기업", "「상생협력법」 제4조에 따른 중견기업", False),
        ("「상생협력법」 제4조의 중견기업", "「상생협력법」 제4조의 중견기업", True),
        ("「상생협력법 시행법」의 중견기업", "「상생협력법」의 중견기업", False),
        ("에 따른 중견기업", "「상생협력법」 시행령 제4조제1항에 따른 중견기업", True),
        ("상생협력법시행령 제4조제1항에 따른 중견기업", "「상생협력법」 시행령 제4조제1항에 따른 중견기업", True),
        ("제7조의 중견기업", "제7조의 중견기업", True),
        ("제7조의 중견기업", "중견기업", False),
    ]
    rows = spark.createDataFrame([(i, t, q, "x") for i, (t, q, _) in enumerate(cases)] + [(0, cases[0][0], cases[0][1], "y")], "id int, text string, quote string, side string")
    found = sorted((r.id, r.equivalent) for r in V.facts_equivalent(rows, ["id"], "text", "quote").collect())
    assert found == sorted([(0, True), *((i, want) for i, (_, _, want) in enumerate(cases))])
    assert V.facts_equivalent(rows.limit(0), ["id"], "text", "quote").count() == 0


def test_select_evidence(spark):
    intro = "소개 문장입니다.\n" * 12
    text = f"□ 개요\n{intro}\n□ 자격\n신청 자격은 중소기업\n\n다만, 대기업 제외\n\n□ 문의\n담당 전화\n\n□ 문의\n담당 전화\n\n{intro}"
    long = "□ 긴 글\n" + "접수 줄입니다.\n" * 400
    rows = spark.createDataFrame([(1, text), (2, "짧은 글"), (3, None), (4, ""), (5, long), (6, " " * 500)], "id long, text string")
    found = {}
    for r in V.select_evidence(rows, "id", "text", 200).collect():
        found.setdefault(r.id, []).append((r.start, r.end))
    parts = [text[s:e] for s, e in sorted(found[1])]
    assert parts == ["□ 자격\n신청 자격은 중소기업\n\n다만, 대기업 제외\n\n", "□ 문의\n담당 전화\n\n"]  # the proviso stays with its unit, copies once
    assert sum(map(len, parts)) + len(V.GAP) * 3 <= 200
    assert found[2] == [(0, 4)] and not {3, 4, 5, 6} & set(found)  # no unit of the long one fits
    units = sorted((r.start, r.end) for r in V.evidence_units(rows.where("id = 5"), "id", "text").collect())
    assert units[0][0] == 0 and units[-1][1] == len(long) and all(a[1] == b[0] for a, b in zip(units, units[1:]))
    assert all(long[e - 1] == "\n" and e - s <= 1600 for s, e in units)
    # lines of which no two fit together are units each; short ones fill a unit up; a long one stays whole
    wide = "".join(c * 999 + "\n" for c in "abcd") + ("e" * 499 + "\n") * 5 + "f" * 2000 + "\n끝"
    cut = sorted((r.start, r.end) for r in V.evidence_units(spark.createDataFrame([(1, wide)], "id long, text string"), "id", "text").collect())
    assert cut == [(0, 1000), (1000, 2000), (2000, 3000), (3000, 4500), (4500, 6000), (6000, 6500), (6500, 8501), (8501, 8502)]


def test_equal_pairs_are_judged_once(spark, monkeypatch):
    """Rows of other keys with the same two texts share one answer, and none is lost."""
    judged, plain = [], V._judged
    monkeypatch.setattr(V, "_judged", lambda pairs: judged.append(pairs.count()) or plain(pairs))
    rows = spark.createDataFrame([(i, ["3명", "4명"][i % 2], "3명") for i in range(40)] + [(7, "3명", None), (None, "3명", "3명")], "id int, text string, quote string")
    found = sorted(((r.id, r.equivalent) for r in V.facts_equivalent(rows, ["id"], "text", "quote").collect()), key=str)
    assert found == sorted([(i, i % 2 == 0) for i in range(40)] + [(7, False), (None, True)], key=str)
    assert judged == [3]
