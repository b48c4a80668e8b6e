"""The published binary linear contract for the 30 night
features (feature order, imputer medians, scaler means and scales,
coefficients, intercept, classes). Scoring must reproduce its outputs, so the
numbers are stated here as published, in feature order."""

NIGHT_CONTRACT = {
    "contract_type": "binary_linear_classifier",
    "feature_order": [
        "in_bed_minutes", "rem_minutes", "deep_minutes", "core_minutes", "asleep_minutes",
        "total_sleep_minutes", "sleep_efficiency", "rem_pct", "deep_pct", "core_pct",
        "hr_mean", "hr_min", "hr_max", "hr_median", "hr_std",
        "hrv_mean", "hrv_min", "hrv_max", "hrv_median", "hrv_std",
        "resp_mean", "resp_min", "resp_max", "resp_median", "resp_std",
        "spo2_mean", "spo2_min", "spo2_max", "spo2_median", "spo2_std",
    ],
    "imputer_median": [
        0.0, 41.0, 8.5, 100.5, 199.0, 199.0, 0.0, 0.2297047970479704, 0.1307966706302021, 0.561035758323058,
        70.62200557960557, 59.0, 84.5, 70.25, 4.5323282372607565,
        44.6596, 29.7009, 64.0222, 41.994475, 12.534284158141485,
        16.06203007518797, 13.5, 21.0, 16.0, 1.544303805075865,
        0.9852941176470588, 0.96, 1.0, 0.98, 0.0123648246606609,
    ],
    "scaler_mean": [
        71.67762284196549, 48.57171314741036, 28.46215139442231, 114.81474103585657, 209.06374501992033,
        209.06374501992033, 0.0, 0.22944566520408, 0.13607235519466537, 0.5468550056665096,
        73.69060399199557, 59.65329482071713, 94.63410199203187, 72.94678446215138, 7.411094650283481,
        46.13540371430649, 30.754593625498003, 69.08413824701195, 43.557450099601596, 13.667603299562403,
        16.07810186410147, 13.233067729083665, 21.0796812749004, 15.911354581673306, 1.5936252252010148,
        0.9851702173565307, 0.95996015936255, 0.9997609561752988, 0.9801394422310759, 0.012348807204945916,
    ],
    "scaler_scale": [
        105.3468336981392, 52.20692086599395, 33.22537973176092, 119.85214389508299, 204.42516315511344,
        204.42516315511344, 1.0, 0.08455275964547286, 0.08647988270629957, 0.11844497819654304,
        9.71535784800325, 2.693278637174998, 25.9986951426711, 9.618461415781118, 6.814097684904005,
        10.467217457715469, 10.842746076141069, 26.83645502545814, 10.093945990014273, 9.457735730356905,
        0.5165946709890765, 1.2766919682785485, 2.4375926783909136, 0.5116769533120692, 0.5007242534472918,
        0.002128867135368655, 0.0024442807410642144, 0.0026672406698511654, 0.0022047752610735733,
        0.0011289277813188005,
    ],
    "coef": [
        0.16110168497483732, 0.019542020009170893, 0.05576862662259554, 0.032051988775560196,
        0.04964804047601306, 0.04964804047601306, 0.0, 0.07811031192198743, 0.1722555432525536,
        -0.0033251948906915163, -0.017046307371244882, -0.12167783806356121, 0.13864715292439295,
        -0.13294992646047926, -0.10919907550792944, -0.015323444966832826, 0.08257326107829059,
        0.08500892789161062, -0.21331934401775204, -0.20073371132247933, 0.25123966006165727,
        -0.16764898491023, -0.21893473744052191, 0.05021338313441903, 0.16598731519777848,
        0.019260207303493822, 0.004185703211457687, 0.17759588624718672, -0.17627751922285456,
        0.11903816210388898,
    ],
    "intercept": -0.007778134442176938,
    "classes": [0, 1],
}
