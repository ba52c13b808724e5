"""Results depend on these being exactly as stated."""

# Features on these chromosomes are left out of marker lists.
SEX_AND_MITO = ("chrX", "chrY", "chrM")

# A tumor sample's id turns into its partner's id by this substitution.
TUMOR_TAG = "_tumor"
NORMAL_TAG = "_normal.tissue"

# Annotation columns and values.
SAMPLE_ID = "sample_id"
MARKER_ID = "marker_id"
STATUS = "cancer_status"
CANCER_TYPE = "cancer_type"
DISEASE_TYPE = "disease_type"
RACE = "race"
NORMAL = "normal"
STATUS_CODES = {"normal": 0, "cancer": 1}
MISSING_TEXT = "NA"
MISSING_TEXTS_STRICT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Cancer types searched for markers.
CANCER_TYPES = ("liver_cancer", "lung_cancer", "ovarian_cancer", "stomach_cancer")
LIVER_TYPES = ("liver_cancer",)

# Study names of marker discovery.
STUDY_DETECTION = "multi.cancer.study_detection"
STUDY_LIVER_CANCER = "liver.cancer.study"
STUDY_LIVER_DISEASE = "liver.disease.study"
STUDY_RACE = "race.study"

# Output column names.
DETECTION_SCORE = "pred.score_multi.cancer"
SURVEILLANCE_SCORE = "pred.score_liver.cancer"
RATIO = "ratio"
PRED_LABEL = "pred_label"
RACE_PRED_LABEL = "pred.label"
TRUE_LABEL = "true_label"

# Classifier settings.
BINARY_CLASSIFIER = "LinearSVC_l2_c1"
OVR_CLASSIFIER = "ovr_LinearSVC_l2_c1"
SIGMOID_SLOPE = 3.0
SIGMOID_SHIFT = 0.0

# Components kept by the reduction step of each study.
DETECTION_COMPONENTS = 500
TYPING_COMPONENTS = 300
SURVEILLANCE_COMPONENTS = 100

# Near-zero-variance and missingness limits.
NZV_FREQ_RATIO = 899.0
NZV_UNIQUE_PERCENT = 1.0
MISSING_SHARE = 0.5

# Moderated test: threshold on the absolute contrast; floor on variances relative to their median.
TREAT_LFC = 1.0
VARIANCE_FLOOR = 1e-5

# Marker ranking defaults.
MARKER_DIFF_CUTOFF = 0.7
MARKERS_PER_CLASS = 50

# Mixture sampling: draws per sample.
MIXTURE_DRAWS = 3000

# Words of a reduction: its name before the number of components, and what means none.
REDUCTION_NAME = "svd"
NO_REDUCTION = ("none", "na", "no", "")
