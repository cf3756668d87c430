"""What kind of notice a text is that offers no support: results, regulations, awards, contests, designations and general notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, of titles and sentences without white space.
GENERAL_TITLE = r"(?:선정|평가|심사|합격|입찰|모집|공모).{0,10}결과|보도자료|행정예고|입법예고|정책발표|설명회개최|시스템점검"
STAFF_RECRUITMENT = r"(?:기간제|공무직|직원|연구원)채용(?!지원|장려|보조|사업)"
BRIEFING_TITLE = r"설명회(?:개최|참석|참가)"
DESIGNATION_TITLE = r"지정.{0,12}(?:고시|공고)|고시.{0,12}지정"
DESIGNATION_ACTION = (
    r"지정(?:을)?(?:해제|변경)?(?:하여|하고|하고이를|하였음을|되었음을|사항을|내용을|및|·|ㆍ|,)?(?:(?:다음|붙임|아래)과같이)?고시(?:합니다|한다|함)"
    r"|지정(?:하였음|되었음)을(?:알립니다|공고합니다)"
)
ADDITIONAL_RECRUITMENT, RECRUITMENT_TITLE = r"추가모집|재공모|신규모집", r"모집|공모|신청|접수|입찰"
CLOSED_TITLE = r"결과|종료|마감|취소|(?:입상작|입상자|수상작|수상자|당선작|당선자)(?:발표|공고|명단)"
RECRUITMENT_ACTION = (
    r"(?:모집|공모)(?:합니다|한다|하고자|하오니|공고|안내|대상|기간)|(?:신청|접수)(?:기간|기한|방법|대상|마감|하세요|하시기|바랍니다)"
    r"|신청(?:을)?받(?:습니다|고있)|신청(?:할수있|가능)|(?:제안서|사업계획서|신청서)(?:를|을)?(?:작성하여)?제출"
)
NON_CURRENT = (
    r"전년도|지난해|과거|예시|견본|참고자료|모집하지않|공모하지않|(?:신청|접수|제출).{0,25}(?:받지않|요구하지않|필요없|필요하지않|없습니다)"
    r"|(?:모집|접수|신청).{0,20}(?:종료되|마감되|완료되|마감하였|종료하였)"
)
OPINION = r"(?:의견|이의)(?:서)?(?:제출|신청|접수)"
RESULT_ACTION = (
    r"(?:선정|평가|심사|합격).{0,12}결과(?:를|을).{0,25}(?:공고|알립|안내|발표|통보)|(?:입상작|입상자|수상작|수상자|당선작|당선자)(?:을|를|은|는)?(?:다음|아래|붙임)?"
    r"(?:(?:과|와)같이)?(?:발표합니다|공고합니다|알립니다|발표하였습니다|선정하였습니다)"
)
SELECTION_TITLE = r"(?:선정|선발|확정)(?:결과)?(?:공고|공개|알림|안내)$"
SELECTION_ACTION = r"(?:선정|선발|확정)결과(?:를|을).{0,25}(?:공고합니다|공고하였습니다|공개합니다|발표합니다|알려드립니다)"
REGULATION_TITLE, PREANNOUNCED = r"규정|규칙|지침|고시", r"행정예고|입법예고"
REGULATION_ACTION = r"(?:규정|규칙|지침|고시).{0,40}(?:제정|개정)하여고시|(?:제정|개정)(?:하여)?고시합니다"
AWARD_TITLE = r"(?:포상|표창)(?:후보자|대상자|유공자)?(?:모집|신청|추천|안내|공고|계획|추가|수정|연장)"
AWARD_PROOF = r"장관표창|포상(?:대상|목적|계획|훈격|규모)|훈격"
DESIGNATION_RECRUITMENT_TITLE = r"선정계획|지정.{0,20}(?:모집|공모|신청)"
CONDITIONAL_DESIGNATION = (
    r"지정되더라도.{0,25}지원.{0,25}(?:확정되는것은아님|확정되지않)|지정신청(?:서)?(?:을|를)?(?:받습니다|접수합니다)|지정을희망하는.{0,20}(?:신청|제출)"
)
FILED_TITLE, FILED = r"(?:지정|인증|허가|승인).{0,16}신청", r"(?:지정|인증|허가|승인)신청이(?:있어|있으므로|접수되어|접수되었)"
OPINION_REQUEST = r"(?:이해관계인|이해관계자|주민).{0,220}(?:의견서?|이의신청).{0,160}(?:제출|접수)"
NEW_APPLICATION_TITLE = r"모집|공모|접수|입찰|(?:신규|추가)신청"
NEW_APPLICATION = (
    r"(?:모집|공모)(?:합니다|한다|하고자|하오니|공고|안내|대상|기간)|(?:지정|인증|허가|승인|지원|참여)신청(?:서)?(?:을|를)?(?:받|접수)|"
    r"(?:제안서|사업계획서|(?<!이의)(?<!의견)신청서)(?:를|을)?(?:작성하여)?제출|(?<!의견)(?<!이의)신청(?:기간|기한|방법|대상|하세요|하시기|바랍니다)"
)
CONTEST_TITLE = r"(?:공모전|경진대회|챌린지)(?:참가자|참가팀|참여자|참여팀)?(?:모집|접수|공고|개최|안내)(?:수정|연장|추가)?(?:공고)?$"
CONTEST_ACTION = r"(?:공모전|경진대회|대회)(?:를|을)?(?:(?:다음|아래)과같이)?(?:개최합니다|개최하오니|개최하고자|공고하오니|진행합니다)"
CONTEST_PRIZE = r"시상(?:내역|계획|규모)|(?:상금|장관상|상품)(?:을|은|의|과|\(|형태|지급)|상금\s*$"
SURVEY, SURVEY_OPERATOR = "수요조사", r"수요조사.{0,15}(?:용역|수행기관|조사기관|운영기관)"
SURVEY_PROOF = r"(?:본|금번|이번)?수요조사는.{0,100}선정(?:하는것이|이)?(?:아닌|아니라).{0,100}의견(?:을)?수렴"
SURVEY_RECRUITMENT = r"(?:지원대상|수혜|수행)(?:기업|기관|과제)(?:을|를)?(?:신규|추가)?모집|(?:이번|본)수요조사(?:참여|응답)(?:기업|기관).{0,80}(?:제공|지원)"
NOT_OPINION_ONLY, PAST = r"의견(?:을)?수렴.{0,12}(?:아니|아님|아닙|않)", r"전년도|지난해|과거|예시|견본"
#: How sentences and lines end, and the characters of a source that are its introduction.
SENTENCE, LINE, INTRODUCTION = r"[。!?]|(?<=\.)\s+|\n\s*\n", r"[\r\n。!?]|(?<=\.)\s+", 6000


def _tight(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _sentences(texts: Column, end: str = SENTENCE) -> Column:
    return F.flatten(F.transform(texts, lambda t: F.transform(F.split(t, end), _tight)))


def notice_nature(df: DataFrame, key: str, title: str, sources: str, general: str | None = None, supported: str | None = None) -> DataFrame:
    """(key, nature): RESULT, REGULATION, AWARD, CONTEST, DESIGNATION_RECRUITMENT, GENERAL, or null where the notice may offer support.

    ``sources`` is an array of a notice's texts.  What a notice itself does stands in the introductions of its sources, their first
    6,000 characters; whether it recruits may stand anywhere.  Sentences on the past, examples and what is no longer asked for
    count for nothing.  A column ``general`` says that a notice was filed as a general one, which counts where it has a text and
    ``supported``, that a type of support was found, is not set.  Null texts and titles are empty.
    """
    texts = F.transform(F.coalesce(F.col(sources), F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))
    known = F.lit(False) if supported is None else F.coalesce(F.col(supported), F.lit(False))
    filed = F.lit(False) if general is None else F.coalesce(F.col(general), F.lit(False))
    rows = df.select(key, _tight(F.coalesce(title, F.lit(""))).alias("t"), texts.alias("texts"), known.alias("known"), filed.alias("filed"))
    rows = rows.withColumns({"intros": F.transform("texts", lambda x: F.substring(x, 1, INTRODUCTION)), "lines": _sentences(F.col("texts"), LINE), "whole": F.transform("texts", _tight)})
    rows = rows.withColumns({"said": _sentences(F.col("intros")), "tight": F.transform("intros", _tight)})
    t = F.col("t")
    has = lambda pattern: t.rlike(pattern)
    current = lambda array, pattern, past=NON_CURRENT: F.exists(array, lambda s: ~s.rlike(past) & s.rlike(pattern))
    shows = lambda array, pattern: F.exists(array, lambda s: s.rlike(pattern))
    recruiting_title = has(ADDITIONAL_RECRUITMENT) | (has(RECRUITMENT_TITLE) & ~has(CLOSED_TITLE) & ~has(OPINION))
    recruits = F.exists("lines", lambda s: ~s.rlike(NON_CURRENT) & ~s.rlike(OPINION) & s.rlike(RECRUITMENT_ACTION))
    survey = F.contains(t, F.lit(SURVEY)) & ~has(SURVEY_OPERATOR) & ~shows("whole", SURVEY_RECRUITMENT)
    survey = survey & F.exists("said", lambda s: ~s.rlike(PAST) & s.rlike(SURVEY_PROOF) & ~s.rlike(NOT_OPINION_ONLY))
    contest = has(CONTEST_TITLE) & F.exists("intros", lambda x: F.exists(F.split(x, SENTENCE), lambda s: ~_tight(s).rlike(NON_CURRENT) & _tight(s).rlike(CONTEST_ACTION)) & _tight(x).rlike(CONTEST_PRIZE))
    opinion = has(FILED_TITLE) & ~has(NEW_APPLICATION_TITLE) & ~shows("whole", NEW_APPLICATION) & F.exists("tight", lambda s: ~s.rlike(NON_CURRENT) & s.rlike(FILED) & s.rlike(OPINION_REQUEST))
    award = has(AWARD_TITLE) & ~has(CLOSED_TITLE) & shows("tight", AWARD_PROOF)
    designation = has(DESIGNATION_RECRUITMENT_TITLE) & shows("tight", CONDITIONAL_DESIGNATION)
    regulation = ~recruiting_title & ~has(PREANNOUNCED) & has(REGULATION_TITLE) & current("said", REGULATION_ACTION)
    selected = has(SELECTION_TITLE) & ~has(ADDITIONAL_RECRUITMENT) & current("said", SELECTION_ACTION)
    result = (~recruiting_title | selected) & ~recruits & current("said", RESULT_ACTION)
    staff = ~has(ADDITIONAL_RECRUITMENT) & (has(STAFF_RECRUITMENT) | (~F.col("known") & has(BRIEFING_TITLE)))
    designated = has(DESIGNATION_TITLE) & current(_sentences(F.col("texts")), DESIGNATION_ACTION)
    marked = F.col("filed") & ~F.col("known") & F.exists("whole", lambda s: s != "")
    plain = staff | (~recruiting_title & ~recruits & (has(GENERAL_TITLE) | designated | marked))
    out = F.when(survey, "GENERAL").when(contest, "CONTEST").when(opinion, "GENERAL").when(award, "AWARD").when(designation, "DESIGNATION_RECRUITMENT").when(regulation, "REGULATION").when(result, "RESULT")
    out = out.when(plain, F.when(has(GENERAL_TITLE) & F.contains(t, F.lit("결과")), "RESULT").otherwise("GENERAL"))
    return rows.select(key, out.alias("nature"))
