"""Fixed values of profile inference: name patterns, value ranges, value words and standard bands.

The patterns, windows, words and their order decide results, so they are stated as they are.
"""

from __future__ import annotations

# Fixed values: (pattern of a whole normalised column name, role, band key, what it is), first match wins.
COLUMN_PATTERNS: list[tuple[str, str | None, str | None, str]] = [
    (r"id|patient[_-]?id|case[_-]?id|record[_-]?id|subject[_-]?id", None, None, "Identifier in the source."),
    (r"age|age[_-]?years?|years?[_-]?old", "age", "age_bracket", "Age in years."),
    (r"age[_-]?group|age[_-]?category|age[_-]?bracket", "age", "age_bracket", "Age group; a survey code needs a mapping to years."),
    (r"sex|gender", "gender", None, "Sex or gender."),
    (r"bmi|body[_-]?mass[_-]?index", "lab", "bmi_band", "Body mass index in kg per square metre."),
    (r"trestbps|ap[_-]?hi|systolic|sbp|bp[_-]?sys", "lab", "bp_band", "Systolic blood pressure in mm Hg."),
    (r"ap[_-]?lo|diastolic|dbp|bp[_-]?dia", "lab", None, "Diastolic blood pressure in mm Hg."),
    (r"chol|cholesterol|total[_-]?cholesterol|tc", "lab", "chol_band", "Cholesterol in serum."),
    (r"hdl|ldl|triglycerides?|trig", "lab", None, "A value of the lipid panel."),
    (r"glucose|gluc|avg[_-]?glucose[_-]?level|fasting[_-]?glucose|hba1c|a1c", "lab", "glucose_band", "Glucose or glycated haemoglobin."),
    (r"fbs|fasting[_-]?blood[_-]?sugar", "lab", None, "Whether fasting blood sugar is above 120 mg/dL."),
    (r"thalach|max[_-]?heart[_-]?rate|peak[_-]?hr", "lab", None, "Highest heart rate under stress."),
    (r"oldpeak|st[_-]?depression", "lab", None, "ST depression by exercise against rest."),
    (r"restecg|resting[_-]?ecg", "lab", None, "ECG at rest."),
    (r"slope|st[_-]?slope", "lab", None, "Slope of the ST segment at peak exercise."),
    (r"ca|num[_-]?major[_-]?vessels", "lab", None, "Major vessels seen by fluoroscopy, 0 to 3."),
    (r"thal|thalassemia", "lab", None, "Thallium stress test: 3 normal, 6 fixed, 7 reversible."),
    (r"height|height[_-]?cm", "lab", None, "Height in cm."),
    (r"weight|weight[_-]?kg", "lab", None, "Weight in kg."),
    (r"tb|total[_-]?bilirubin|t[_-]?bilirubin", "lab", None, "Total bilirubin in mg/dL."),
    (r"db|direct[_-]?bilirubin|d[_-]?bilirubin|conjugated[_-]?bilirubin", "lab", None, "Direct bilirubin in mg/dL."),
    (r"alkphos|alp|alkaline[_-]?phosphatase|alk[_-]?phos", "lab", None, "Alkaline phosphatase in IU/L."),
    (r"sgpt|alt|alanine[_-]?aminotransferase|alanine[_-]?transaminase", "lab", None, "Alanine aminotransferase in IU/L."),
    (r"sgot|ast|aspartate[_-]?aminotransferase|aspartate[_-]?transaminase", "lab", None, "Aspartate aminotransferase in IU/L."),
    (r"tp|total[_-]?protein|total[_-]?proteins|proteins", "lab", None, "Total protein in g/dL."),
    (r"alb|albumin", "lab", None, "Albumin in serum, g/dL."),
    (r"a[_-]?g[_-]?ratio|albumin[_-]?globulin[_-]?ratio|globulin[_-]?ratio", "lab", None, "Ratio of albumin to globulin."),
    (r"bp", "lab", "bp_band", "Blood pressure in mm Hg."),
    (r"sg", "lab", None, "Specific gravity of urine."),
    (r"al", "lab", None, "Albumin in urine, grades 0 to 5."),
    (r"su", "lab", None, "Sugar in urine, grades 0 to 5."),
    (r"rbc", "lab", None, "Red blood cells under the microscope."),
    (r"pc", "lab", None, "Pus cells under the microscope."),
    (r"pcc", "lab", None, "Clumps of pus cells in urine."),
    (r"ba", "lab", None, "Bacteria in urine."),
    (r"bgr", "lab", "glucose_band", "Blood glucose at random, mg/dL."),
    (r"bu", "lab", None, "Blood urea in mg/dL."),
    (r"sc", "lab", None, "Creatinine in serum, mg/dL."),
    (r"sod", "lab", None, "Sodium in serum, mEq/L."),
    (r"pot", "lab", None, "Potassium in serum, mEq/L."),
    (r"hemo", "lab", None, "Haemoglobin in g/dL."),
    (r"pcv", "lab", None, "Packed cell volume in percent."),
    (r"wbcc", "lab", None, "White blood cell count."),
    (r"rbcc", "lab", None, "Red blood cell count."),
    (r"dm", "comorbidity", None, "Diabetes mellitus."),
    (r"cad", "comorbidity", None, "Coronary artery disease."),
    (r"ane", "comorbidity", None, "Anaemia."),
    (r"pe", "symptom", None, "Pedal oedema."),
    (r"appet", "descriptor", None, "Appetite."),
    (r"hypertension|highbp|high[_-]?bp|htn", "comorbidity", None, "High blood pressure."),
    (r"highchol|high[_-]?cholesterol|hyperlipidemia", "comorbidity", None, "High cholesterol."),
    (r"heart[_-]?disease|heartdiseaseorattack|chd|cvd|myocardial[_-]?infarction|mi", "comorbidity", None, "Heart disease or infarction."),
    (r"stroke", "comorbidity", None, "Stroke in the past."),
    (r"diabetes|diabetic", "comorbidity", None, "Diabetes."),
    (r"kidney|ckd|renal", "comorbidity", None, "Kidney disease."),
    (r"polyuria", "symptom", None, "Excess of urine."),
    (r"polydipsia", "symptom", None, "Excess of thirst."),
    (r"polyphagia", "symptom", None, "Excess of hunger."),
    (r"cp|chest[_-]?pain", "symptom", None, "Type of chest pain."),
    (r"exang|exercise[_-]?induced[_-]?angina", "symptom", None, "Angina by exercise."),
    (r"weakness|fatigue|tiredness", "symptom", None, "Weakness or fatigue."),
    (r"sudden[_-]?weight[_-]?loss|weight[_-]?loss", "symptom", None, "Sudden loss of weight."),
    (r"itching|pruritus", "symptom", None, "Itching."),
    (r"irritability|mood[_-]?lability", "symptom", None, "Irritability."),
    (r"visual[_-]?blurring|blurred[_-]?vision", "symptom", None, "Blurred vision."),
    (r"delayed[_-]?healing|wound[_-]?healing", "symptom", None, "Slow healing of wounds."),
    (r"partial[_-]?paresis|paresis", "symptom", None, "Partial loss of muscle strength."),
    (r"muscle[_-]?stiffness", "symptom", None, "Stiff muscles."),
    (r"alopecia|hair[_-]?loss", "symptom", None, "Loss of hair."),
    (r"obesity", "symptom", None, "Obesity as reported."),
    (r"genital[_-]?thrush|candidiasis", "symptom", None, "Genital thrush."),
    (r"diffwalk|difficulty[_-]?walking", "symptom", None, "Trouble with walking or stairs."),
    (r"smoker|smoke|smoking|smoking[_-]?status|tobacco", "lifestyle", None, "Smoking."),
    (r"alco|alcohol|drinker|drinking|hvyalcoholconsump", "lifestyle", None, "Drinking of alcohol."),
    (r"active|physactivity|physical[_-]?activity|exercise", "lifestyle", None, "Physical activity."),
    (r"fruits?", "lifestyle", None, "Fruit once a day or more."),
    (r"veggies|vegetables?", "lifestyle", None, "Vegetables once a day or more."),
    (r"diet", "lifestyle", None, "Diet."),
    (r"work[_-]?type|occupation|job", "lifestyle", None, "Kind of work."),
    (r"residence|residence[_-]?type|location|urban|rural", "geography", None, "Town or country."),
    (r"education|edu", "descriptor", None, "Level of education."),
    (r"income|earnings", "descriptor", None, "Level of income."),
    (r"marital|married|ever[_-]?married", "descriptor", None, "Marital status."),
    (r"genhlth|general[_-]?health|self[_-]?rated[_-]?health", "descriptor", None, "Health as rated by the person."),
    (r"menthlth|mental[_-]?health", "descriptor", None, "Days of poor mental health of the last 30."),
    (r"physhlth|physical[_-]?health", "descriptor", None, "Days of poor physical health of the last 30."),
    (r"anyhealthcare|healthcare|insurance|coverage", "descriptor", None, "Health insurance."),
    (r"nodocbccost", "descriptor", None, "No visit to a doctor because of cost."),
    (r"cholcheck|chol[_-]?check", "descriptor", None, "Cholesterol checked in the last 5 years."),
    (r"edad|alter|age?", "age", "age_bracket", "Age in years (name in another language)."),
    (r"sexo|geschlecht|sexe", "gender", None, "Sex or gender (name in another language)."),
    (r"peso|gewicht|poids", "lab", None, "Weight in kg (name in another language)."),
    (r"altura|estatura|grosse|taille", "lab", None, "Height in cm (name in another language)."),
    (r"presion|presi_n|pression|druck", "lab", "bp_band", "Blood pressure (name in another language)."),
    (r"colesterol|cholesterin", "lab", "chol_band", "Cholesterol (name in another language)."),
    (r"glucosa|glucos|zucker", "lab", "glucose_band", "Glucose (name in another language)."),
    (r"fumador|raucher|fumeur", "lifestyle", None, "Smoking (name in another language)."),
    (r".*_mm_?hg|.*_mmhg", "lab", "bp_band", "A pressure, by its unit mm Hg."),
    (r".*_mg_?dl|.*_mgdl", "lab", None, "A value in mg/dL, by its unit."),
    (r".*_mmol_?l|.*_mmoll", "lab", None, "A value in mmol/L, by its unit."),
    (r".*_iu_?l|.*_u_?l|.*_iul", "lab", None, "An enzyme's activity, by its unit."),
    (r".*_g_?dl|.*_gdl", "lab", None, "A concentration in g/dL, by its unit."),
    (r".*_meq_?l", "lab", None, "An electrolyte in mEq/L, by its unit."),
    (r".*_bpm|.*_per_?min", "lab", None, "A rate a minute, by its unit."),
    (r".*_kg", "lab", None, "A mass, by its unit."),
    (r".*_cm|.*_mm", "lab", None, "A length, by its unit."),
]

# Fixed values: (name, role, band key, 5th percentile, 95th percentile, median: each a window), first match wins.
RANGES = [
    ("systolic-BP", "lab", "bp_band", (60, 110), (140, 260), (105, 160)),
    ("diastolic-BP", "lab", None, (30, 70), (80, 140), (60, 100)),
    ("BMI", "lab", "bmi_band", (10, 20), (28, 80), (20, 40)),
    ("glucose", "lab", "glucose_band", (20, 80), (140, 600), (70, 200)),
    ("cholesterol", "lab", "chol_band", (80, 160), (200, 500), (150, 280)),
    ("heart-rate", "lab", None, (30, 70), (100, 240), (55, 120)),
    ("age-years", "age", "age_bracket", (0, 20), (40, 120), (20, 80)),
]

# Names of target columns, the strongest first.
TARGET_NAMES = ["class", "label", "target", "outcome", "diagnosis", ".*_binary", "diabetes", "stroke", "cardio", "heartdiseaseorattack", "num", "selector", "dataset", "status", "y", ".*_label", ".*_outcome"]

# Pairs of texts as (the one that counts 1, the one that counts 0).
KNOWN_PAIRS = [
    ("yes", "no"),
    ("true", "false"),
    ("male", "female"),
    ("m", "f"),
    ("positive", "negative"),
    ("present", "absent"),
    ("present", "notpresent"),
    ("urban", "rural"),
    ("abnormal", "normal"),
    ("poor", "good"),
    ("ckd", "notckd"),
    ("disease", "healthy"),
    ("malignant", "benign"),
    ("m", "b"),
]

# Words of targets with two values, and of targets with more.
POSITIVE_WORDS = {"1", "yes", "positive", "true", "present", "ckd", "disease", "malignant"}
NEGATIVE_WORDS = {"0", "no", "negative", "false", "absent", "notckd", "healthy", "benign"}
NEGATIVE_HINTS = r"\b(low|normal|healthy|benign|negative|absent|no|none|mild)\b"
POSITIVE_HINTS = r"\b(high|severe|positive|death|died|disease|abnormal|critical|malignant)\b"

# Standard bands as (label, upper bound).
STANDARD_BANDS = {
    "age_bracket": [("0-17", 18), ("18-39", 40), ("40-59", 60), ("60-79", 80), ("80+", ".inf")],
    "bmi_band": [("underweight", 18.5), ("normal", 25), ("overweight", 30), ("obese", ".inf")],
    "bp_band": [("normal", 120), ("elevated", 130), ("stage-1-htn", 140), ("stage-2-htn", 180), ("crisis", ".inf")],
    "chol_band": [("desirable", 200), ("borderline", 240), ("high", ".inf")],
    "glucose_band": [("normal", 100), ("elevated", 126), ("diabetic-range", ".inf")],
}

# What each role is about, for providers that compare texts.
ROLE_TEXTS = {
    "age": "age of a patient, years of age, age group",
    "gender": "sex of a patient, gender, male or female",
    "symptom": "symptom that a patient reports, sign of illness, pain, weakness, thirst, fatigue, itching, loss of weight",
    "lab": "result of a laboratory test, vital sign, biomarker, blood pressure, cholesterol, glucose, creatinine, enzyme, heart rate, voice measure",
    "comorbidity": "other disease of a patient, earlier diagnosis, hypertension, diabetes, heart disease, stroke, kidney disease",
    "lifestyle": "way of life, smoking, alcohol, exercise, diet, occupation",
    "geography": "place of residence, town or country, region, postal code",
    "descriptor": "social description, education, income, marital status, insurance, health as rated by the person",
}

# Presets as (backend, model, size in GB).
PRESETS = {
    "off": ("noop", "", 0.0),
    "embed-only": ("embedding", "BAAI/bge-small-en-v1.5", 0.13),
    "tiny": ("ollama", "qwen2.5:1.5b", 1.0),
    "small": ("ollama", "phi3.5", 2.3),
    "small-bio": ("ollama", "biomistral:7b", 4.5),
    "mid": ("ollama", "qwen2.5:7b", 4.5),
    "mid-bio": ("ollama", "meditron:7b", 4.0),
    "cloud": ("gemini", "gemini-2.5-flash", 0.0),
}
PRIVACY = ("strict", "balanced", "cloud-only")
