"""Deadlines, amounts, condition rows and evidence sections on literal notices."""

import datetime

from gazetta.operators import amounts as A
from gazetta.operators import deadlines as D
from gazetta.operators import sections as S
from pyspark.sql import functions as F

MAY = datetime.date(2031, 5, 20)


def read(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    return [r[0] for r in df.select(D.application_deadline(F.col("t"), **options)).collect()]


def test_one_date_or_the_end_of_a_range(spark):
    fields = ["2031-05-20", "2031년 5월 20일 17시", "2031. 4. 2.(수) 10:00 ~ 2031. 5. 20.(화) 18:00", "2031/04/02부터 2031년 5월 20일까지", "∼2031.5.20. 까지"]
    assert read(spark, fields) == [MAY] * 5
    labelled = [
        "공고일은 2031-04-02이며 접수 마감일은 2031-05-20입니다.", "제출 기한: 2031년 5월 20일, 발표일은 2031-06-01", "접수기간: 2031-04-02 ~ 2031. 5. 20.",
        "신청서 마감일시: 2031-05-20 18:00, 신청 종료일 2031-05-20", "신청 마감일은 2031-05-20이며 2031-04-30 평가 기준입니다.",
    ]
    assert read(spark, labelled, require_label=True) == [MAY] * 5


def test_uncertain_dates_stay_unknown(spark):
    texts = [
        "2031-04-02부터 5월 20일까지", "2031-05-20부터", "2031-05-20 ~", "2031-05-20부터 2031-04-02까지", "2031-04-02 또는 2031-05-20", "2031-02-30", "2031-04-02 ~ 2031-05-20, 2031-06-01",
        "신청 마감일 2031-05-20, 제출 마감일 2031-05-21", "심사 마감일은 2031-05-20입니다.", "접수 시작일 2031-05-20", "사업기간 2031-04-02 ~ 2031-05-20", "접수기간: 2031-05-20 이후 상시", "", None, "기한 없음",
    ]
    assert read(spark, texts) == [None] * len(texts) == read(spark, texts, require_label=True)
    assert read(spark, ["2031-05-20"], require_label=True) == [None]


def test_a_reason_completes_a_range_without_a_year(spark):
    rows = [
        ("2031-04-02부터 5월 20일까지", "접수 마감일은 2031-05-20입니다.", MAY), ("2031-04-02 ~ 5.20.", "접수 마감일은 2031-05-20입니다.", MAY),
        ("2031-04-02부터 5월 21일까지", "접수 마감일은 2031-05-20입니다.", None), ("2031-04-02 또는 2031-05-20", "접수 마감일은 2031-05-20입니다.", None),
        ("추후 안내", "공고일은 2031-04-02, 신청 마감일은 2031-05-20입니다.", MAY), ("추후 안내", "2031-05-20", None), (None, None, None), ("2031-05-20", None, MAY),
        ("2031-05-20", "접수 마감일은 2031-06-01입니다.", MAY),
    ]
    df = spark.createDataFrame([(i, f, r) for i, (f, r, _) in enumerate(rows)], "i int, f string, r string")
    assert {r.i: r.deadline for r in D.deadlines(df, "i", "f", "r").collect()} == {i: want for i, (_, _, want) in enumerate(rows)}


def test_each_property_of_an_amount(spark):
    texts = {
        "과제당 매년 최대 2.5억 원을 3년간 지원": [(250_000_000, "원", "<=", "project", "annual", ""), (3, "년", "=", "", "", "")],
        "기업별 약 300만원 초과": [(3_000_000, "원", ">", "company", "", "")],
        "신규예산 총 1,234백만원 내외": [(1_234_000_000, "원", "~", "total", "total", "")],
        "추정가격 2천만원 미만 5개": [(20_000_000, "원", "<", "contract", "", ""), (5, "개", "=", "", "", "")],
        "정부지원금 1억원, 기관부담금 2억원": [(100_000_000, "원", "=", "", "", "state"), (200_000_000, "원", "=", "", "", "own")],
        "30%는 정부가 지원": [(30, "%", "=", "", "", "state")],
        "월 50만원 이하, 일간 1만원": [(500_000, "원", "<=", "", "monthly", ""), (10_000, "원", "=", "", "daily", "")],
        "총 지원금 6명 3천원": [(6, "명", "=", "", "", ""), (3_000, "원", "=", "total", "", "")],
        "최소 10명 이상 12개월": [(10, "명", ">=", "", "", ""), (12, "개월", "=", "", "", "")],
        "금액 미정": [], None: [], "": [],
        "1.2.3억원": [(None, "원", "=", "", "", "")],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {i: [] for i in range(len(texts))}
    for r in sorted(A.money_facts(df, "i", "t").collect()):
        found[r.i].append((None if r.value is None else float(r.value), r.unit, r.comparator, r.scope, r.frequency, r.payer))
    assert found == {i: [(v if v is None else float(v), *rest) for v, *rest in facts] for i, facts in enumerate(texts.values())}


def test_quantity_keys_tell_scopes_and_payers_apart(spark):
    texts = ["정부지원금 1억 원", "정부지원금 1억원", "기관부담금 1억 원", "과제당 1억원", "지원금: 1~3억원", "지원금: 2~3억원", "없음", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    keys = [(tuple(r.quantities), tuple(r.numbers)) for r in A.quantity_key(df, "i", "t").orderBy("i").collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 6 and keys[6] == keys[7] == ((), ()) and keys[4][1] == ("1",)


def prepared(spark, group, text):
    df = spark.createDataFrame([(1, group, text)], "id int, label string, body string")
    return [(r.text, r.group_label, r.headers, r.cells, r.structure) for r in S.prepare_rows(df, ["id"], "label", "body").orderBy("row_no").collect()]


def test_prepared_rows_carry_groups_and_headers(spark):
    text = (
        "가. 매출 10억원 ([참고2] 참조)\n도약 트랙\n① 업력 7년\n(공통) 신청 제한\n[표]\n구분\t지원한도\n구분\t국비 (70%)\n일반 과제\t2억원\n소형 과제\t3억원\n소형 과제\t3억원\n[/표]\n"
        "[표]\n업종\t비고\n제조업\t전체\n[/표]\n구분 업종 비고 안내\n\n □■\n"
    )
    assert prepared(spark, "□ 신청 자격", text) == [
        ("매출 10억원", "신청 자격", [], [], "text"),
        ("업력 7년", "도약 트랙", [], [], "text"),
        ("(공통) 신청 제한", "도약 트랙", [], [], "text"),  # a firm group is not changed by a bracket
        ("일반 과제 2억원", "일반 과제", ["구분", "지원한도 / 국비 (70%)"], ["일반 과제", "2억원"], "table_row"),
        ("소형 과제 3억원", "소형 과제", ["구분", "지원한도 / 국비 (70%)"], ["소형 과제", "3억원"], "table_row"),
        ("제조업 전체", "소형 과제", ["업종", "비고"], ["제조업", "전체"], "table_row"),
        ("구분 업종 비고 안내", "소형 과제", [], [], "ambiguous_table"),
    ]
    # weak labels follow one another until one is firm; after a programme line, which is not firm, they do again
    assert [(t, g) for t, g, *_ in prepared(spark, None, "(청년) 가점\n대상: 기업\n(기업) 소상공인\n일반과제: 제외\n대상: 중견\n육성 프로그램\n대상: 학교")] == [
        ("(청년) 가점", "청년"), ("대상: 기업", "대상"), ("(기업) 소상공인", "대상"), ("일반과제: 제외", "일반과제"), ("대상: 중견", "일반과제"), ("대상: 학교", "대상"),
    ]
    # one line is a label or a heading by what group stands above it
    assert [(t, g) for t, g, *_ in prepared(spark, "", "구분: 성장 유형\n하나\n성장과제\n구분: 성장 유형\n둘")] == [("구분: 성장 유형", "구분"), ("하나", "구분"), ("둘", "구분: 성장 유형")]
    assert prepared(spark, None, None) == [] == prepared(spark, "가", " \n\t")


def plain_groups(first, lines):
    """Group by group in a loop: (weak label, heading, cell) of each line."""
    import re

    group, out = first, []
    for weak, heading, cell in lines:
        firm = bool(re.fullmatch(S.GROUP, group))
        if weak is not None and not firm:
            group = weak
        elif heading is not None:
            group = heading
            continue
        if cell is not None:
            group = cell
        out.append(group)
    return out


def test_groups_against_a_loop(spark):
    import random

    rng, sources, want = random.Random(9), [], {}
    for i in range(60):
        first, text, lines = rng.choice(["", "자격", "성장과제"]), [], []
        for n in range(12):
            kind = rng.randrange(5)
            word = rng.choice(["조건", "일반과제", "성장 유형", "A트랙"])
            if kind == 0:
                text.append(f"{word}: 내용 {n}")
                lines.append((word, None, None))
            elif kind == 1:
                text.append(f"{n}단계 {word if word != '조건' else '새 프로그램'}")
                lines.append((None, text[-1], None))
            elif kind == 2:
                text.append(f"{word}: {n}단계 유형")  # label or heading
                lines.append((word, text[-1], None))
            elif kind == 3:
                text.append(f"{word}\t값 {n}")
                lines.append((None, None, word if word != "조건" else None))
            else:
                text.append(f"그냥 {n}번 줄")
                lines.append((None, None, None))
        sources.append((i, first, "\n".join(text)))
        want[i] = plain_groups(first, lines)
    df = spark.createDataFrame(sources, "id int, label string, body string")
    found = {}
    for r in S.prepare_rows(df, ["id"], "label", "body").orderBy("id", "row_no").collect():
        found.setdefault(r.id, []).append(r.group_label)
    assert found == want


def test_qualification_sections(spark):
    inner = "□ 신청자격\n제조업을 하는\n10인 미만 소공인\n[표]\n유형\t조건\n가. 유형\t특허 기업\n□ 문의\n[/표]\n※ 단, 예외\n"
    sources = [
        (1, "사업개요", "□ 사업목적\n지원\n" + inner + "□ 제출서류\n증명서"), (2, "□ 지원대상", "중소기업"), (3, "가점 사항", "수출액 기업"), (4, "제출서류", "매출 증명"), (5, "기관 소개", "연혁"),
        (6, "", "안내\n\U000f02b1 선정 대상\n품목 생산\n\U000f02b2 신청 절차\n서류"), (7, "[별도 참여 역할] 구매기관", "□ 신청자격\n기업"), (8, None, None), (9, "지원대상", "  \n "),
        (10, "[상위 구역] 참여 자격\n[원문 구역] 세부", "법인"), (11, "개요", "□ 자격요건\n하나\n□ 기타\n둘\n□ 지원대상\n셋\n"),
    ]
    df = spark.createDataFrame(sources, "id int, label string, body string")
    found = {r.id: (r.priority, r.excerpt) for r in S.qualification_sections(df, ["id"], "label", "body").collect()}
    assert found == {
        1: (0, inner), 2: (1, "중소기업"), 3: (2, "수출액 기업"), 5: (3, "연혁"), 6: (1, "\U000f02b1 선정 대상\n품목 생산\n"), 10: (1, "법인"),
        11: (0, "□ 자격요건\n하나\n" + S.BETWEEN + "□ 지원대상\n셋\n"),
    }


def plain_selection(rows, max_bytes, max_sources, topics):
    """The choice in a loop over (place, priority, excerpt, topics)."""
    best = min((p for _, p, _, _ in rows), default=9)
    chosen, used = {}, 0
    for priority in (0, 1, 2) if best <= 1 else (2, 3):
        queues = [[r for r in rows if r[1] == priority and t in r[3]] for t in range(topics)]
        while any(queues):
            for q in queues:
                if q:
                    place, _, excerpt, _ = q.pop(0)
                    if place not in chosen and used + len(excerpt.encode()) <= max_bytes and len(chosen) < max_sources:
                        chosen[place] = priority
                        used += len(excerpt.encode())
    return chosen


def test_selected_sections_against_a_loop(spark):
    import random

    rng, sources, want = random.Random(4), [], {}
    words = ["매출", "업력", "특허"]
    topics = {w: w for w in words}
    for doc in range(40):
        rows, seen = [], set()
        for place in range(rng.randint(0, 14)):
            label, priority = rng.choice([("□ 신청자격", 0), ("지원대상", 1), ("우대", 2), ("기관 소개", 3), ("문의", None)] if doc % 4 else [("우대", 2), ("기관 소개", 3)])
            some = rng.sample(words, rng.randint(0, 2))
            text = " ".join(some) + " 조건" * rng.choice([1, 2, 8, 20, 60])
            sources.append((doc, place, label, text))
            if rng.random() < 0.3:  # the same in another layout
                sources.append((doc, place + 100, label, "「" + text.replace(" ", "\t") + "」"))
            if priority is not None and some and len(text.encode()) <= 300 and text not in seen:
                rows.append((place, priority, text, {words.index(w) for w in some}))
                seen.add(text)
        chosen = plain_selection(rows, 300, 5, 3)
        if chosen:
            want[doc] = chosen
    df = spark.createDataFrame(sources, "doc int, place int, label string, body string")
    found = {}
    for r in S.select_sections(df, "doc", "place", "label", "body", 300, 5, topics).collect():
        found.setdefault(r.doc, {})[r.place] = r.priority
    assert found == want and len(found) > 20


def test_support_types_of_sections(spark):
    from gazetta.operators import criteria as C

    notices = [
        ("", "□ 지원내용\n마케팅 비용을 지원합니다.\n□ 신청방법\n융자 지원 신청", ("MARKET", 200)),
        ("교육훈련 공고", "사업개요\n훈련과정 코칭 및 상담 제공\n지원내용 :\n컨설팅 제공과 교육지원", ("WORKFORCE", 220)),
        ("", "□ 지원내용\n지원대상: 융자 기업\n전년도 실증 지원\n융자 지원 제외 기업", None),  # administrative, past, excluded
        ("", "□ 지원내용\n■ 스마트공장 구축 지원 안내\n설명\n■ 접수 기간 안내\n실증 수행 지원", ("ADOPTION", 200)),  # a box that supports, then one that ends it
        ("", "사업목적\n□ 스마트공장 구축 지원 안내", None),  # an overview ends at any box
        ("", "□ 지원내용\n" + "설명하는 줄입니다.\n" * 36 + "인증 취득 지원합니다.", None),
        ("", "□ 지원내용\n" + "설명하는 줄입니다.\n" * 30 + "인증 취득 지원합니다.", ("CERTIFICATION", 200)),
        ("", "□ 지원내용\n해외진출과 융자 지원합니다.", ("MARKET", 200)),  # both: the earlier one
        ("", "신청서\n□ 지원내용\n융자 지원합니다.", None), ("", "", None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(notices)], "id int, title string, body string")
    found = {r.id: (r.type, r.score) if r.type else None for r in C.support_types(df, "id", "title", "body").collect()}
    assert found == {i: want for i, (_, _, want) in enumerate(notices)}


def test_eligibility_topics(spark):
    from gazetta.operators import criteria as C

    df = spark.createDataFrame([(1, "벤처기업 인증과 특허를 가진 법인사업자"), (2, "국세청 안내"), (3, None), (4, "Trl 7, iso27001")], "id int, clause string")
    found = {(r.id, r.criterion, r.topic_group) for r in C.eligibility_topics(df, "clause").collect()}
    assert found == {(1, "CERTIFICATION", "TECHNOLOGY"), (1, "IP", "TECHNOLOGY"), (1, "BUSINESS_FORM", "COMPANY"), (4, "TRL", "TECHNOLOGY"), (4, "QUALITY", "TECHNOLOGY")}


def test_writing_language(spark):
    from gazetta.operators import forms as M

    forms = [
        ("a.hwp", "사업계획서\n영어로 작성", "en"), ("a.hwp", "기업명은 영문으로 작성", "ko"), ("a.hwp", "서식\n1\n2\n3\n영어로 작성", "ko"), ("a.hwp", "서식\n1\n2\n3\n전체 항목은 영어로 작성", "en"),
        ("a.hwp", "이 서식은 영문 작성하지 않아도 됩니다", "ko"), ("a.hwp", "Write this form in English, not in Korean", "en"), ("a.hwp", "본 문서는 국문 작성, 요약은 영문 기재", "ko"), ("영문 양식.docx", "", "en"),
        ("영문주소.docx", "", "ko"), ("x.docx", "one two three four", "en"), ("x.docx", "one two three", "ko"), (None, None, "ko"), ("English 국문.hwp", "", "ko"),
    ]
    df = spark.createDataFrame([(i, f, t) for i, (f, t, _) in enumerate(forms)], "id int, file string, body string")
    assert {r.id: r.language for r in M.writing_language(df, "id", "file", "body").collect()} == {i: want for i, (_, _, want) in enumerate(forms)}


def test_score_tables(spark):
    from gazetta.operators import forms as M

    tables = {
        0: [["구분", "가점 항목", "점수"], ["1", "여성기업", "2점"], ["2", "수상 실적", "+1.5"]], 1: [["감점 기준", "감점"], ["제재", "−3 점"], ["포기", "2점"]], 2: [["우대 사항", "배점"], ["가", "-1점"]],
        3: [["감점사항", "점수"], ["가", "+1점"]], 4: [["가점사항", "점수"], ["가", "협의"], ["나", "1점"]], 5: [["가점사항", "점수"], ["", "1점"]], 6: [["가점사항", "점수"], ["가", "1점", "x"]], 7: [["항목", "내용"], ["가", "1점"]], 8: [["평가내용", "점수"]],
    }
    rows = spark.createDataFrame([(1, t, n, c) for t, cells in tables.items() for n, c in enumerate(cells)], "id int, table_no int, row_no int, cells array<string>")
    notes = spark.createDataFrame([(1, 0, "합계는 총 3점 이내"), (1, 1, "최대 점수 없음")], "id int, table_no int, note string")
    found = sorted(tuple(r)[1:] for r in M.score_tables(rows, "id", notes).collect())
    assert found == [(0, 1, "여성기업", 2.0, "bonus", 3.0, 3.0), (0, 2, "수상 실적", 1.5, "bonus", 3.0, 3.0), (1, 1, "제재", 3.0, "deduction", 5.0, None), (1, 2, "포기", 2.0, "deduction", 5.0, None)]


def test_natures_of_notices(spark):
    from gazetta.operators import natures as N

    notices = [
        ("수요조사 안내", ["본 수요조사는 과제를 선정하는 것이 아닌 의견을 수렴하는 것입니다."], "GENERAL"), ("수요조사 안내", ["본 수요조사는 과제를 선정하는 것이 아닌 의견을 수렴합니다.", "수혜 기업을 모집"], None),
        ("창업 경진대회 참가자 모집", ["경진대회를 개최합니다. 시상 내역은 아래와 같습니다."], "CONTEST"), ("창업 경진대회 참가자 모집", ["경진대회를 개최합니다."], None),
        ("특구 지정 신청 공람", ["지정 신청이 있어 이해관계인은 의견서를 제출하시기 바랍니다."], "GENERAL"), ("입상자 발표", ["입상자를 발표합니다."], "RESULT"), ("지원 대상 선정 공고", ["선정 결과를 공고합니다."], "RESULT"),
        ("운영 규정 개정", ["전년도에 규정을 개정하여 고시합니다."], None), ("연구원 채용 공고", [""], "GENERAL"), ("사업 설명회 참석 안내", [None], "GENERAL"), ("안내", ["내용"], "GENERAL"), ("안내", [" "], None), (None, None, None),
        ("사업 안내", ["신청 기간: 5월"], None),
    ]
    df = spark.createDataFrame([(i, t, x, True) for i, (t, x, _) in enumerate(notices)], "id int, title string, sources array<string>, filed boolean")
    found = {r.id: r.nature for r in N.notice_nature(df, "id", "title", "sources", "filed").collect()}
    assert found == {i: want for i, (_, _, want) in enumerate(notices)} | {1: "GENERAL", 7: "GENERAL"}  # filed as general ones
    assert N.notice_nature(df.where("id = 7"), "id", "title", "sources").first().nature is None
