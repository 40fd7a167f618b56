"""Fixed values of the simulated worlds, by motif. Results have the published distributions only with these."""

# Weights of latent traits in the conversion score.
CONVERSION = {
    "fit_dominant": {"account_fit": 2.5, "budget_readiness": 1.5, "problem_awareness": 0.5, "engagement_propensity": 0.5, "sales_friction": -0.5},
    "intent_dominant": {"engagement_propensity": 2.5, "problem_awareness": 1.5, "account_fit": 0.5, "sales_friction": -0.5},
    "sales_execution_sensitive": {"account_fit": 1.0, "engagement_propensity": 1.0, "responsiveness": 1.5, "sales_friction": -2.0},
    "demo_trial_mediated": {"engagement_propensity": 2.0, "problem_awareness": 1.0, "account_fit": 1.0, "sales_friction": -0.5},
    "buying_committee_friction": {"account_fit": 1.5, "contact_authority": 1.5, "budget_readiness": 1.0, "sales_friction": -2.5},
}
# Weights in the stage-transition score.
TRANSITION = {
    "fit_dominant": {"account_fit": 2.0, "problem_awareness": 1.0, "responsiveness": 0.5},
    "intent_dominant": {"engagement_propensity": 2.0, "problem_awareness": 1.5, "responsiveness": 0.5},
    "sales_execution_sensitive": {"responsiveness": 2.0, "engagement_propensity": 1.0, "sales_friction": -1.5},
    "demo_trial_mediated": {"engagement_propensity": 2.5, "account_fit": 0.5},
    "buying_committee_friction": {"contact_authority": 2.0, "account_fit": 1.0, "sales_friction": -2.0},
}
# Fixed values: (base rate, scale) of the daily conversion hazard; daily touch rate; (share that reaches negotiation, days spent there).
HAZARD = {"fit_dominant": (0.008, 0.06), "intent_dominant": (0.010, 0.07), "sales_execution_sensitive": (0.004, 0.05), "demo_trial_mediated": (0.007, 0.06), "buying_committee_friction": (0.003, 0.04)}
TOUCH_RATE = {"fit_dominant": 0.40, "intent_dominant": 0.55, "sales_execution_sensitive": 0.35, "demo_trial_mediated": 0.60, "buying_committee_friction": 0.30}
REACH = {"fit_dominant": (0.85, 22.0), "intent_dominant": (0.85, 22.0), "sales_execution_sensitive": (0.40, 18.0), "demo_trial_mediated": (0.70, 20.0), "buying_committee_friction": (0.32, 16.0)}
# Shifts of the mean of latent traits, which is one half otherwise.
LATENT_SHIFT = {
    "fit_dominant": {"account_fit": 0.10, "budget_readiness": 0.05},
    "intent_dominant": {"engagement_propensity": 0.12, "problem_awareness": 0.10},
    "sales_execution_sensitive": {"sales_friction": 0.12, "responsiveness": -0.08},
    "demo_trial_mediated": {"engagement_propensity": 0.08, "problem_awareness": 0.06},
    "buying_committee_friction": {"contact_authority": -0.10, "sales_friction": 0.15},
}
LEAD_TRAITS = ("account_fit", "budget_readiness", "process_maturity", "problem_awareness", "contact_authority", "responsiveness", "engagement_propensity", "sales_friction")

# The stages of a lead, in order, and those with sales activity.
STAGES = ("mql", "sal", "sql", "demo_scheduled", "demo_completed", "proposal_sent", "negotiation")
DAILY_CHURN, DIRECT_SHARE = 0.004, 0.01
# Categories with their weights.
EMPLOYEES = {"200-499": 0.35, "500-999": 0.35, "1000-1999": 0.20, "2000+": 0.10}
REVENUE = {"$1M-$10M": 0.25, "$10M-$50M": 0.40, "$50M-$200M": 0.25, "$200M+": 0.10}
REVENUE_MIDPOINT = {"$1M-$10M": 25_000.0, "$10M-$50M": 55_000.0, "$50M-$200M": 85_000.0, "$200M+": 140_000.0}
MATURITY = {"low": 0.30, "medium": 0.45, "high": 0.25}
MATURITY_MEAN = {"low": 0.25, "medium": 0.50, "high": 0.75}
SENIORITY = {"individual_contributor": 0.25, "manager": 0.30, "director": 0.25, "vp": 0.15, "c_suite": 0.05}
EMAIL = {"corporate": 0.80, "personal": 0.12, "unknown": 0.08}
TOUCH_TYPES = ("email", "call", "linkedin_message", "content_download", "webinar")
SESSION_TYPES = ("website", "pricing_page", "demo_page")
ACTIVITY_TYPES = ("call", "email", "meeting", "demo")
OUTCOMES = ("connected", "no_answer", "left_voicemail", "meeting_set", "demo_completed")

# Fixed values of the customer lifecycle: weekly churn and expansion, monthly payment failure, each with latent weights.
CUSTOMER_TRAITS = ("product_fit", "adoption_velocity", "champion_strength", "organizational_stability", "budget_stability")
LIFECYCLE = {
    "product_led_retention": {
        "churn": (0.0034, {"product_fit": -2.0, "adoption_velocity": -0.8, "champion_strength": -0.5}),
        "renewal": (6.0, {"champion_strength": -1.5, "product_fit": -1.0}),
        "expansion": (0.0045, {"adoption_velocity": 1.5, "product_fit": 1.0}, (0.20, 0.60)),
        "payment": (0.012, {"budget_stability": -1.5}, 4, 0.70),
    },
    "relationship_led_retention": {
        "churn": (0.0042, {"champion_strength": -2.0, "product_fit": -0.8, "organizational_stability": -0.6}),
        "renewal": (12.0, {"champion_strength": -2.5, "organizational_stability": -1.0}),
        "expansion": (0.0030, {"champion_strength": 1.5, "adoption_velocity": 0.8}, (0.15, 0.50)),
        "payment": (0.013, {"budget_stability": -1.5, "organizational_stability": -0.5}, 4, 0.65),
    },
    "expansion_led_growth": {
        "churn": (0.0026, {"adoption_velocity": -1.5, "product_fit": -1.5, "budget_stability": -0.5}),
        "renewal": (4.0, {"adoption_velocity": -1.5, "champion_strength": -1.0}),
        "expansion": (0.0075, {"adoption_velocity": 2.0, "product_fit": 1.0, "budget_stability": 0.5}, (0.30, 1.00)),
        "payment": (0.010, {"budget_stability": -1.2}, 4, 0.75),
    },
    "payment_fragile": {
        "churn": (0.0018, {"budget_stability": -2.5, "organizational_stability": -1.0, "product_fit": -0.5}),
        "renewal": (8.0, {"budget_stability": -2.0, "champion_strength": -1.0}),
        "expansion": (0.0020, {"adoption_velocity": 1.0, "budget_stability": 1.5}, (0.10, 0.30)),
        "payment": (0.027, {"budget_stability": -3.0, "organizational_stability": -1.0}, 3, 0.64),
    },
    "churner_dominated": {
        "churn": (0.0046, {"product_fit": -1.8, "champion_strength": -1.2, "adoption_velocity": -0.8}),
        "renewal": (10.0, {"champion_strength": -1.5, "product_fit": -1.0}),
        "expansion": (0.0018, {"adoption_velocity": 1.0, "product_fit": 0.8}, (0.10, 0.25)),
        "payment": (0.012, {"budget_stability": -2.0}, 3, 0.65),
    },
}
ONBOARDING_PEAK, ONBOARDING_WEEKS, MOST = 2.5, 4.0, 0.95
PLANS = {"starter": (800, 2_000, 8), "growth": (2_000, 6_000, 25), "enterprise": (6_000, 20_000, 80)}
