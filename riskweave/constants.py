"""Values that fix the semantics of the cohort risk model.

FIXED VALUES (must equal the application this library re-implements; they
are part of the results, not tuning knobs):

- base features, in order: attendance_rate, quiz_average,
  assignment_submission_rate, mobile_engagement_freq, financial_aid_status
- engineered features: academic_performance_index, financial_academic_risk
- academic_performance_index = 0.4 * attendance + 0.4 * quiz + 0.2 * submission
- financial_academic_risk = clip((1 - aid / 10) * (1 - submission / 100), 0, 1)
- default decision threshold tau = 0.4432
- risk band: score >= tau -> HIGH; score >= 0.6 * tau -> MEDIUM; else LOW
- heat-map band: >= 0.8 critical, >= 0.6 high, >= 0.4 medium, else low
- cohort rule: at risk >= 0.4432, critical >= 0.75
- rule baseline: attendance < 60 and quiz < 40
- drift: KS threshold 0.10, PSI significant 0.20, PSI warning 0.10, 10 bins,
  empty PSI share replaced by 1e-4
- forecast: alpha 0.4, beta 0.3, 4 steps ahead, last 12 points, horizon 1..8
- trend labels: > 0.05 WORSENING, > 0.01 SLIGHTLY_WORSENING,
  < -0.05 IMPROVING, < -0.01 SLIGHTLY_IMPROVING, else STABLE
- split 70/15/15, seed 42, 5 folds
- IMD band map: 0-10% 1, 10-20 2, 10-20% 2, 20-30% 3, 30-40% 4, 40-50% 5,
  50-60% 6, 60-70% 7, 70-80% 8, 80-90% 9, 90-100% 10; unknown 5
- final result map: Pass 0, Distinction 0, Fail 1, Withdrawn 1; other 0
- intervention types: SMS, EMAIL, COUNSELLING, TUTORING, OTHER
- risk bands: LOW, MEDIUM, HIGH
- alert text limit 160 characters (157 + "...")
- masked id: first 8 + "..." + last 5, unchanged when length <= 16
- fairness aid bands (0,3] "Low (1-3)", (3,6] "Mid (4-6)", (6,10] "High (7-10)";
  groups < 5 dropped; rates in percent round 1, AUC round 4
- pilot targets: AUC 80 (on the x100 scale), intervention conversion 60 %,
  counsellor usability 70; amber at 0.75 * target
- feature labels: Attendance Rate, Quiz Average, Assignment Submission Rate,
  Mobile Engagement, Financial Aid Status, Academic Performance Index,
  Financial-Academic Risk
- synthetic quality thresholds: KS complement 0.80, correlation similarity 0.75
- training budgets: 300 boosted iterations (depth 5 here, step 0.05, row and
  feature share 0.8), patience 20, 100 search trials, 400 iterations of the
  stack's learners and 400 forest trees, 200 of the learning curve (depth 4),
  1000 logistic iterations
- intervention statuses: PENDING, SENT, COMPLETED, FAILED
- alert texts (operators/explain.py): "EWS ALERT: Student ... flagged ... Key
  factors: ... Please contact within 5 days.", "Student ... has been flagged as
  HIGH risk (score: ...). Top factors: ..."
- recommended action texts (attendance < 60, quiz < 40, aid < 4, none):
  "Schedule an attendance review meeting within 3 days."
  "Refer to academic support / peer tutoring programme."
  "Review financial aid eligibility — student may qualify for bursary."
  "Monitor student progress weekly. No urgent intervention required."
"""

from __future__ import annotations

BASE_FEATURES = [
    "attendance_rate",
    "quiz_average",
    "assignment_submission_rate",
    "mobile_engagement_freq",
    "financial_aid_status",
]
ENGINEERED_FEATURES = ["academic_performance_index", "financial_academic_risk"]
ALL_FEATURES = BASE_FEATURES + ENGINEERED_FEATURES
PERCENT_FEATURES = ["attendance_rate", "quiz_average", "assignment_submission_rate"]
NONNEG_FEATURES = ["mobile_engagement_freq", "financial_aid_status"]

FEATURE_LABELS = {
    "attendance_rate": "Attendance Rate",
    "quiz_average": "Quiz Average",
    "assignment_submission_rate": "Assignment Submission Rate",
    "mobile_engagement_freq": "Mobile Engagement",
    "financial_aid_status": "Financial Aid Status",
    "academic_performance_index": "Academic Performance Index",
    "financial_academic_risk": "Financial-Academic Risk",
}

TAU = 0.4432
MEDIUM_FACTOR = 0.6
CRITICAL_COHORT = 0.75
HEAT_BANDS = [(0.8, "critical"), (0.6, "high"), (0.4, "medium")]
HEAT_DEFAULT = "low"

RULE_ATTENDANCE = 60.0
RULE_QUIZ = 40.0

KS_THRESHOLD = 0.10
PSI_SIGNIFICANT = 0.20
PSI_WARNING = 0.10
PSI_BINS = 10
PSI_FLOOR = 1e-4

FORECAST_ALPHA = 0.4
FORECAST_BETA = 0.3
FORECAST_STEPS = 4
FORECAST_WINDOW = 12
FORECAST_MAX_HORIZON = 8
TRAJECTORY_POINTS = 8
TREND_LABELS = [
    (0.05, "WORSENING"),
    (0.01, "SLIGHTLY_WORSENING"),
    (-0.05, "IMPROVING"),
    (-0.01, "SLIGHTLY_IMPROVING"),
]

# Training budgets of the application; every fit takes them as arguments.
BOOSTED_ITERATIONS, BOOSTED_DEPTH, BOOSTED_STEP, BOOSTED_SUBSAMPLE = 300, 5, 0.05, 0.8
BOOSTED_PATIENCE = 20
STACK_ITERATIONS = 400
CURVE_ITERATIONS, CURVE_DEPTH = 200, 4
SEARCH_TRIALS = 100
LOGISTIC_ITERATIONS = 1000
FOREST_TREES, FOREST_DEPTH = 400, 5

SPLIT_TRAIN, SPLIT_VALID, SPLIT_TEST = 0.70, 0.15, 0.15
SEED = 42
N_FOLDS = 5

IMD_MAP = {
    "0-10%": 1, "10-20": 2, "10-20%": 2, "20-30%": 3, "30-40%": 4,
    "40-50%": 5, "50-60%": 6, "60-70%": 7, "70-80%": 8, "80-90%": 9, "90-100%": 10,
}
IMD_DEFAULT = 5.0
RESULT_LABEL = {"Pass": 0, "Distinction": 0, "Fail": 1, "Withdrawn": 1}

INTERVENTION_TYPES = ["SMS", "EMAIL", "COUNSELLING", "TUTORING", "OTHER"]
INTERVENTION_STATUSES = ["PENDING", "SENT", "COMPLETED", "FAILED"]
RISK_BANDS = ["LOW", "MEDIUM", "HIGH"]

MESSAGE_LIMIT = 160
MASK_VISIBLE = 8
MASK_TAIL = 5
MASK_MIN_LENGTH = 16

FAIRNESS_MIN_GROUP = 5
FAIRNESS_BANDS = [(0.0, 3.0, "Low (1-3)"), (3.0, 6.0, "Mid (4-6)"), (6.0, 10.0, "High (7-10)")]
PILOT_TARGETS = [("auc_x100", 80.0), ("conversion_rate", 60.0), ("usability_score", 70.0)]
PILOT_AMBER = 0.75
KS_COMPLEMENT_MIN = 0.80
CORR_SIMILARITY_MIN = 0.75

ID_COLUMN_FALLBACK = ["student_id", "id_student", "anon_id"]

ACTION_TEXTS = [
    "Schedule an attendance review meeting within 3 days.",
    "Refer to academic support / peer tutoring programme.",
    "Review financial aid eligibility — student may qualify for bursary.",
    "Monitor student progress weekly. No urgent intervention required.",
]
