"""Table and model configuration.

A ``ModelSpec`` names the columns a (line) table plays roles with: id,
target, date, categorical / numeric / text features, constraint columns and
group keys.  Defaults are the reference's published settings.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (must equal the reference's for equal results) ----------
# k neighbours and weighting used for every table in both applications
DEFAULT_K = 7
DEFAULT_WEIGHTS = "distance"
# model-selection grid
SELECTION_K_OPTIONS = (3, 5, 7, 9)
SELECTION_WEIGHT_OPTIONS = ("uniform", "distance")
CV_FOLDS = 5
CV_SEED = 42
SELECTION_SAMPLE_ROWS = 10000
SELECTION_MIN_PER_CLASS = 5
ELIMINATION_TOLERANCE = 0.05
EARLY_STOP_ROUNDS = 10
BEST_MINIMAL_TOLERANCE = 0.01
RARE_CLASS_MIN_ROWS = 5
RARE_CLASS_PCT_OF_MAJORITY = 0.01
TEXT_NGRAM_MIN = 2
TEXT_NGRAM_MAX = 5
TEXT_MAX_DF = 0.95
TEXT_K = 7
NOT_APPLICABLE = "NOT_APPLICABLE"
TARGET_NULL_TOKENS = ("None", "nan", "NaN")
REQUEST_NULL_TOKENS = ("nan", "none")  # compared lower-cased
# task names of the evaluation set
TASK_GST = "GST_VALIDATION"
TASK_ACCOUNT = "ACCOUNT_MAPPING_VALIDATION"
# ---------------------------------------------------------------------------

GROUP_KEYS = ("tenant_id", "table_name")


@dataclass(frozen=True)
class ModelSpec:
    """Column roles of one line table for kNN / text scoring."""

    id_col: str
    target: str
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    vector: str | None = None            # dense array<float|double> feature
    text: tuple[str, ...] = ()
    constraints: tuple[str, ...] = ()
    date_col: str | None = None
    group_keys: tuple[str, ...] = GROUP_KEYS
    k: int = DEFAULT_K
    weights: str = DEFAULT_WEIGHTS
    must_have: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.categorical) + tuple(self.numeric)

    def with_(self, **kw) -> "ModelSpec":
        d = {f: getattr(self, f) for f in self.__dataclass_fields__}
        d.update(kw)
        return ModelSpec(**d)


@dataclass(frozen=True)
class TableConfig:
    """Per-table training defaults (one row of the training config)."""

    table_name: str
    target: str
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    date_col: str
    k: int = DEFAULT_K
    weights: str = DEFAULT_WEIGHTS
    filter_rare: bool = True

    def spec(self, id_col: str = "line_item_id") -> ModelSpec:
        return ModelSpec(id_col=id_col, target=self.target, categorical=self.categorical, numeric=self.numeric, date_col=self.date_col, k=self.k, weights=self.weights)


# ---- fixed values: default features of the tax validation's four tables ----
TAX_TABLES = (
    TableConfig("accrec_accpay", "tax_type", ("description", "source_type", "account_name", "item_code"), ("tax_amount", "line_amount"), "journal_date"),
    TableConfig("cashrec_cashpaid", "tax_type", ("description", "account_name", "contact_name"), ("total_tax", "line_amount", "sub_total"), "journal_date"),
    TableConfig("accreccredit_accpaycredit", "tax_type", ("account_name", "contact_name", "description", "reference"), ("total_tax", "sub_total"), "journal_date"),
    TableConfig("expclaim", "tax_type", ("description", "contact_name"), ("line_amount", "tax_amount", "receipt_total_tax"), "receipt_date"),
)
# ---------------------------------------------------------------------------

# ---- fixed values: text features of the account mapping's tables ----------
TEXT_TABLES = {
    "accrec_accpay": ModelSpec(id_col="line_item_id", target="account_code", text=("description", "contact_name"), constraints=("source_type",), date_col="journal_date"),
    "cashrec_cashpaid": ModelSpec(id_col="line_item_id", target="account_code", text=("bank_account_name", "contact_name", "description"), constraints=("source_type",), date_col="journal_date"),
    "accreccredit_accpaycredit": ModelSpec(id_col="line_item_id", target="account_code", text=("description", "contact_name"), constraints=("source_type",), date_col="journal_date"),
    "expclaim": ModelSpec(id_col="line_item_id", target="account_code", text=("description", "contact_name"), date_col="receipt_date"),
}
# ---------------------------------------------------------------------------
