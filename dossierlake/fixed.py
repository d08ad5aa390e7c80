"""Vocabularies, thresholds and lookup tables the results depend on.

Everything here is data, stated as text. Operators take these as defaults and accept
other values, so that another locale can supply its own vocabulary.
"""

# --- fixed values: domains -----------------------------------------------------------

FACILITY_LABELS = {
    "public": "공공시설",
    "residential": "주거시설",
    "office": "업무시설",
    "transport": "교통시설",
    "commercial": "상업시설",
    "cultural": "문화·집회시설",
    "hospitality": "숙박·위락시설",
    "education": "교육·연구시설",
    "masterplan": "마스터플랜",
    "industrial": "산업시설",
    "medical": "의료시설",
    "mixed_use": "복합시설",
    "reconstruction": "재건축사업",
    "alternative": "대안설계",
}

PAGE_TYPES = [
    "COVER", "TOC_HERO", "SITE_CONTEXT", "CONCEPT", "SPECIAL_SPACE",
    "RENDERING_EXT", "RENDERING_INT", "SITE_PLAN", "LANDSCAPE",
    "FLOOR_PLAN", "SECTION", "ELEVATION", "CIRCULATION",
    "HEALTH_CENTER", "TECHNICAL", "AREA_TABLE", "SUSTAINABILITY",
    "UNIT_PLAN", "INCENTIVE_TABLE", "BRANDING",
    "BUSINESS_VIABILITY", "AREA_INCREASE", "VIEW_ANALYSIS",
    "COMMUNITY_PROGRAM", "COMPANY_PORTFOLIO", "CONSTRUCTION_PLAN",
    "UNIT_PLAN_PENTHOUSE",
]

BRIEF_PAGE_TYPES = [
    "BRIEF_OVERVIEW", "BRIEF_PROJECT_INFO", "BRIEF_SITE", "BRIEF_PROGRAM",
    "BRIEF_DESIGN_MASSING", "BRIEF_DESIGN_FACADE", "BRIEF_DESIGN_SUSTAIN",
    "BRIEF_DESIGN_SPECIAL", "BRIEF_DESIGN_GUIDE", "BRIEF_TECHNICAL",
    "BRIEF_REGULATIONS", "BRIEF_EVALUATION", "BRIEF_SUBMISSION", "BRIEF_ADMIN",
]

WINNING_RESULTS = ["win", "contracted"]

# --- fixed values: page rules --------------------------------------------------------

DEFAULT_PAGE_TYPE = "CONCEPT"
DEFAULT_BRIEF_PAGE_TYPE = "BRIEF_DESIGN_GUIDE"
STRICT_CONFIDENCE_FLOOR = 0.65
STRICT_FALLBACK = {
    "BUSINESS_VIABILITY": "AREA_TABLE",
    "AREA_INCREASE": "AREA_TABLE",
    "VIEW_ANALYSIS": "SITE_PLAN",
    "COMMUNITY_PROGRAM": "SPECIAL_SPACE",
    "COMPANY_PORTFOLIO": "BRANDING",
    "CONSTRUCTION_PLAN": "TECHNICAL",
    "UNIT_PLAN_PENTHOUSE": "UNIT_PLAN",
}

# headers that never belong to a scoring page
NOT_SCORING_HEADER = [
    r"결과\s*발표", r"결과\s*공고", r"시상\s*식", r"시상금|시상\s*내역", r"보상비",
    r"입상작", r"당선작", r"상품\s*및\s*내용", r"\b상\s*품\b", r"\[\s*서식",
    r"별\s*첨", r"부\s*록", r"\bAppendix\b", r"\bForm\b", r"소\s*명\s*서",
    r"검토\s*의견서", r"확인\s*서", r"동의\s*서", r"신청\s*서", r"지원\s*서",
    r"공\s*고\b", r"공고\s*문",
]
FORM_HEADER = [r"\[\s*서식", r"\[\s*양식", r"\bForm\b", r"별\s*첨", r"부\s*록", r"\bAppendix\b"]

SKIPPED_TYPES = ["COVER", "RENDERING_EXT", "RENDERING_INT"]
LOWEST_PRIORITY_TYPES = [
    "COVER", "RENDERING_EXT", "RENDERING_INT", "BRANDING",
    "BRIEF_SUBMISSION", "BRIEF_ADMIN",
]
TILED_TYPES = [
    "AREA_TABLE", "TECHNICAL", "INCENTIVE_TABLE", "BUSINESS_VIABILITY", "AREA_INCREASE",
]
TILED_CONFIDENCE = 0.7
NO_DIGITAL_TEXT_TYPES = [
    "AREA_TABLE", "TECHNICAL", "INCENTIVE_TABLE", "BUSINESS_VIABILITY", "AREA_INCREASE",
    "BRIEF_PROGRAM", "BRIEF_REGULATIONS", "BRIEF_EVALUATION", "BRIEF_PROJECT_INFO",
]
OCR_FIRST_TYPES = [
    "AREA_TABLE", "TECHNICAL", "SUSTAINABILITY", "BUSINESS_VIABILITY", "AREA_INCREASE",
    "COMPANY_PORTFOLIO", "CONSTRUCTION_PLAN",
]
OCR_MIN_CHARS = 80
DESIGN_TYPES = [
    "BRIEF_DESIGN_MASSING", "BRIEF_DESIGN_GUIDE", "BRIEF_DESIGN_FACADE",
    "BRIEF_DESIGN_SUSTAIN", "BRIEF_DESIGN_SPECIAL",
]
SCORING_TAIL_TYPES = ["BRIEF_SUBMISSION", "BRIEF_DESIGN_GUIDE"]

# --- fixed values: measures ----------------------------------------------------------

MEASURES = [
    "total_floor_area_sqm", "area_above_ground_sqm", "area_below_ground_sqm",
    "site_area_sqm", "building_area_sqm", "building_coverage_ratio_pct",
    "floor_area_ratio_pct", "floors_above", "floors_below", "parking_count",
]
STAT_MEASURES = [
    "total_floor_area_sqm", "site_area_sqm", "building_area_sqm",
    "floor_area_ratio_pct", "building_coverage_ratio_pct",
    "floors_above", "floors_below", "parking_count",
]
COVERAGE_TOLERANCE_PP = 3.0
FAR_TOLERANCE_PP = 5.0
FLOOR_AREA_SLACK = 0.9
BUILDING_SITE_SLACK = 1.02
MEASURE_BOUNDS = {
    "building_coverage_ratio_pct": (0, 100),
    "floor_area_ratio_pct": (0, 1500),
    "floors_above": (0, 120),
    "floors_below": (0, 12),
    "parking_count": (0, 50000),
}
# source field -> measure, by the block that states it
PROGRAM_FIELD_MAP = {
    "total_required_floor_area_sqm": "total_floor_area_sqm",
    "site_area_sqm": "site_area_sqm",
    "building_coverage_limit_pct": "building_coverage_ratio_pct",
    "floor_area_ratio_limit_pct": "floor_area_ratio_pct",
    "max_floors_above": "floors_above",
    "max_floors_below": "floors_below",
    "required_parking": "parking_count",
    "building_coverage_ratio_limit_pct": "building_coverage_ratio_pct",
}
EVALUATION_TOLERANCE = {
    "site_area_sqm": (10.0, 0.01),
    "building_area_sqm": (5.0, 0.02),
    "total_floor_area_sqm": (50.0, 0.01),
    "area_above_ground_sqm": (50.0, 0.01),
    "area_below_ground_sqm": (30.0, 0.02),
    "floor_area_ratio_pct": (0.5, 0.02),
    "building_coverage_ratio_pct": (0.5, 0.02),
    "floors_above": (0.0, 0.0),
    "floors_below": (0.0, 0.0),
    "parking_count": (2.0, 0.02),
}
EVALUATION_METHOD = {
    "structure_system": ("keyword", None),
    "zoning": ("normalize", None),
    "mass_type": ("exact", None),
    "certification": ("jaccard", 0.6),
    "concept_keywords": ("jaccard", 0.3),
}
STRUCTURE_ALIASES = {
    "RC": ["RC", "철근콘크리트", "RC조", "r.c", "reinforced concrete"],
    "SRC": ["SRC", "철골철근콘크리트"],
    "철골": ["철골", "강구조", "SS", "S조", "steel"],
    "CFT": ["CFT", "충전형강관"],
    "PC": ["PC", "프리캐스트", "precast"],
    "목구조": ["목구조", "CLT", "목조", "timber"],
}

# --- fixed values: brief vocabulary --------------------------------------------------

BID_AXIS_MARKERS = [
    "사업수행능력", "참여기술자", "유사용역", "유사 용역", "신용도",
    "가격평가", "가격 평가", "실적세대", "실적건수", "회사실적", "경영상태",
]
COMPETITION_AXIS_MARKERS = [
    "배치계획", "배치 계획", "공간계획", "공간 계획", "기술계획", "기술 계획",
    "설계개념", "설계 개념", "경관", "창의성", "계획설계", "디자인", "동선계획",
    "조경계획", "단위세대", "특화계획",
]
BID_TEXT_MARKERS = [
    "적격심사", "낙찰", "용역업자", "협상에 의한 계약", "협상에의한계약",
    "입찰참가자격", "입찰참여", "종합평점", "적격통과", "추정가격", "예정가격",
]
COMPETITION_TEXT_MARKERS = [
    "심사위원", "당선작", "출품작", "응모작", "응모자격", "작품설명",
    "설계공모", "설계 공모", "공모지침", "심사기준표", "당선자",
]
EMPHASIS_MARKERS = [
    "특히", "반드시", "필히", "중점", "우선", "핵심",
    "강조", "유의", "주의", "필수", "엄수",
]
PLACEMENT_WORDS = [
    "층", "저층", "중층", "상층", "지하", "지상", "옥상", "배치", "위치", "인접",
    "접함", "면한", "면하", "주출입", "진출입", "진입", "별동", "독립", "동선 분리",
    "조닝", "남측", "북측", "동측", "서측", "저층부", "상층부", "1층", "2층",
]
FACILITY_CONFLICT_KEYWORDS = {
    "public": ["연구원", "연구소", "병원", "공장", "산업단지", "리조트", "오피스텔", "백화점"],
    "residential": ["청사", "연구원", "병원", "공장", "학교", "호텔"],
    "office": ["청사", "연구원", "병원", "학교", "호텔"],
    "transport": ["청사", "연구원", "병원", "공장", "학교", "호텔"],
    "commercial": ["청사", "연구원", "병원", "공장", "학교"],
    "cultural": ["청사", "연구원", "병원", "공장"],
    "hospitality": ["청사", "연구원", "병원", "공장"],
    "education": ["청사", "병원", "공장", "호텔", "백화점"],
    "industrial": ["청사", "연구원", "병원", "학교", "호텔"],
    "medical": ["청사", "연구원", "공장", "학교", "호텔"],
    "reconstruction": ["청사", "연구원", "공장", "학교", "호텔"],
    "alternative": ["청사", "연구원", "공장", "학교", "호텔"],
}
ZONE_USES = [
    "제1종전용주거지역", "제2종전용주거지역",
    "제1종일반주거지역", "제2종일반주거지역", "제3종일반주거지역", "준주거지역",
    "중심상업지역", "일반상업지역", "근린상업지역", "유통상업지역",
    "전용공업지역", "일반공업지역", "준공업지역",
    "보전녹지지역", "생산녹지지역", "자연녹지지역",
]
PARKING_DEMAND_WORDS = ["확보", "이상", "계획", "설치", "조성"]
PARKING_OPERATION_WORDS = ["운영", "기존", "현 ", "개방", "공유", "인근", "광장", "유수지", "마트"]
REVIEW_WORDS = ["심의"]
LIMIT_WORDS = ["건폐율", "용적률", "높이"]
LOW_CONFIDENCE_TOKENS = ["미확인", "추정"]
RISKY_UNITS = ["만원", "억", "원", "%", "세대", "가구", "호"]
PROGRAM_CATEGORIES = {
    "core": ["주차", "기계실", "전기실", "코어", "계단실", "방재", "설비",
             "PIT", "PARKING", "저수조", "발전기"],
    "culture": ["도서관", "전시", "강당", "갤러리", "공연", "스튜디오", "문화",
                "박물관", "아트", "시네마", "극장", "미디어"],
    "commerce": ["상가", "근린생활", "리테일", "카페", "음식점", "판매", "상업",
                 "식당", "F&B"],
    "residence": ["주거", "세대", "아파트", "주호", "유닛", "거실", "침실",
                  "UNIT", "펜트하우스"],
    "office": ["사무실", "오피스", "업무", "회의실", "OFFICE", "비즈니스"],
    "public": ["관리", "복지", "주민", "공공", "복합", "커뮤니티", "센터",
               "청사", "민원", "조합", "지원"],
}
LEGACY_GRADES = {"상": "B", "중": "C", "하": "D"}
GRADE_BANDS = [("A", 8.5), ("B", 7.0), ("C", 5.0), ("D", 3.0)]
GRADE_LABELS = {"A": "우수", "B": "우수", "C": "보통", "D": "미흡", "E": "미흡"}
AREA_DECORATION = r"^[\s　·•▪▶◀◆◇★☆※○●◦□■▢▣▤▥▦▧▨▩△▲▽▼\-–—]+"
AREA_SUBTOTAL = r"소\s*계|합\s*계|총\s*계|누\s*계|^총\s|(전용\s*)?계\s*$"
SCORING_SUBTOTAL = r"소\s*계|합\s*계|총\s*계|^합계|^total"

# --- fixed values: search ------------------------------------------------------------

SEARCH_WEIGHTS = {
    "competition_id": 0.5,
    "facility_text": 2.0,
    "ranking": 1.0,
    "differentiators": 1.5,
    "winner_patterns": 1.2,
    "concept_keywords": 1.5,
    "alignment": 0.3,
    "extra_meta": 1.0,
}
FACILITY_SYNONYMS = {
    "public": ["공공시설", "시청", "구청", "관공서", "청사", "도서관", "문화시설", "체육관"],
    "residential": ["주거시설", "공동주택", "아파트", "단지", "주거"],
    "office": ["업무시설", "오피스", "사옥", "복합업무"],
    "transport": ["교통시설", "역사", "터미널", "환승센터", "철도역", "버스터미널"],
    "commercial": ["상업시설", "쇼핑몰", "백화점", "마트", "상가"],
    "cultural": ["문화시설", "공연장", "박물관", "미술관", "집회시설"],
    "hospitality": ["숙박시설", "호텔", "리조트", "레저시설", "위락시설"],
    "education": ["교육시설", "학교", "대학", "캠퍼스", "연구시설"],
    "masterplan": ["마스터플랜", "도시계획", "단지계획", "종합계획"],
    "industrial": ["산업시설", "공장", "물류센터", "산업단지"],
    "medical": ["의료시설", "병원", "요양원", "재활센터", "보건소"],
    "mixed_use": ["복합시설", "복합개발", "복합단지"],
    "reconstruction": ["재건축", "재개발", "정비사업"],
    "alternative": ["대안설계", "리모델링"],
}
PROCUREMENT_SYNONYMS = {
    "competition": ["경쟁공모", "설계공모", "공모"],
    "negotiated": ["수의계약", "수의"],
    "invited": ["지명공모", "지명", "초청"],
    "turnkey": ["턴키", "일괄입찰", "기술제안"],
    "private": ["민간발주", "민간"],
    "other": ["기타"],
}
PHASE_SYNONYMS = {
    "planning": ["기획", "기획설계"],
    "concept": ["계획", "계획설계", "컨셉"],
    "basic_design": ["기본설계", "기본"],
    "detailed_design": ["실시설계", "실시"],
    "cm": ["CM", "사업관리", "감리"],
}

# --- fixed values: geometry and text blocks ------------------------------------------

WORLD_3857 = 20037508.342789244
FLOOR_HEIGHT_M = 4.3
REQUEST_FLOOR_HEIGHT_M = 4.0
FORCE_CUT_PARAGRAPHS = 60
FORCE_CUT_CHARS = 12000
HEADER_MAX = 60
SECTION_NUMBER = r"^(제\d+장|\d+(\.\d+){0,3})\s"
SECTION_NUMBER_ANY_DEPTH = r"^(제\d+장|\d+(\.\d+)*)\s"
CAPTION = r"\[\s*(표|양식|서식|별표)\s*\d+"
CONTENTS_LINE = r"\t\d+\s*$"
FIGURE_LINE = r"^(그림\s*\d+|Fig\.)"
CONTINUED = r"\(\s*계속\s*\)"
SOURCE_HEAD = 4000
SOURCE_TAIL = 2000
CUT_MARK = "\n\n[...생략...]\n\n"
