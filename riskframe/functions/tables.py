"""Fixed lookup tables of the credit domain."""

from __future__ import annotations

# Loan statuses that count as default and as paid.
DEFAULT_STATUSES = (
    "Charged Off",
    "Default",
    "Late (31-120 days)",
    "Does not meet the credit policy. Status:Charged Off",
)
PAID_STATUSES = (
    "Fully Paid",
    "Does not meet the credit policy. Status:Fully Paid",
)

# Columns known when a loan is granted.
ORIGINATION_COLUMNS = (
    "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade",
    "emp_length", "home_ownership", "annual_inc", "verification_status",
    "purpose", "dti", "delinq_2yrs", "earliest_cr_line", "fico_range_low",
    "fico_range_high", "inq_last_6mths", "mths_since_last_delinq",
    "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
    "mort_acc", "pub_rec_bankruptcies",
)

# Model features in model order.
FEATURES = (
    "loan_amnt", "term", "int_rate", "installment", "emp_length", "home_ownership",
    "annual_inc", "verification_status", "purpose", "dti", "delinq_2yrs",
    "inq_last_6mths", "mths_since_last_delinq", "open_acc", "pub_rec", "revol_bal",
    "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies",
    "credit_history_months", "fico_score", "emp_length_missing", "log_annual_inc",
    "loan_to_income", "installment_to_income", "dti_x_income", "grade_numeric",
    "delinq_ever", "high_utilization", "has_mortgage", "has_bankruptcy",
    "sub_grade_numeric",
)

# Silver columns filled with their median.
MEDIAN_COLUMNS = (
    "mort_acc", "pub_rec_bankruptcies", "revol_util", "dti",
    "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "total_acc",
)

CORE_COLUMNS = ("loan_amnt", "int_rate", "grade", "fico_range_low")
CATEGORICAL_COLUMNS = ("purpose", "verification_status", "home_ownership")
HOME_KEPT = ("RENT", "OWN", "MORTGAGE")
GRADES = "ABCDEFG"
BINARY_COLUMNS = (
    "delinq_ever", "high_utilization", "has_mortgage", "has_bankruptcy", "emp_length_missing",
)

# Protected attributes with group labels by code, the privileged
# code and the text shown for the attribute.
PROTECTED_ATTRIBUTES = {
    "home_ownership": (
        {0: "MORTGAGE", 1: "OTHER", 2: "OWN", 3: "RENT"}, 0, "Home Ownership Status",
    ),
    "verification_status": (
        {0: "Not Verified", 1: "Source Verified", 2: "Verified"}, 2, "Income Verification Status",
    ),
    "emp_length_missing": (
        {0: "Reported", 1: "Not Reported"}, 0, "Employment Length Reporting",
    ),
}

# Rejected-application columns and their silver names.
REJECTED_RENAMES = {
    "Amount Requested": "loan_amnt",
    "Risk_Score": "fico_score",
    "Debt-To-Income Ratio": "dti",
    "Employment Length": "emp_length",
    "Application Date": "application_date",
    "State": "state",
}

# Notice code and wording per feature, and the feature's display name.
REASONS = {
    "loan_amnt": (22, "Loan amount or terms relative to credit profile", "Loan Amount"),
    "term": (22, "Loan amount or terms relative to credit profile", "Loan Term"),
    "int_rate": (20, "Assigned credit risk grade", "Interest Rate"),
    "installment": (23, "Monthly payment obligation too high", "Monthly Installment"),
    "emp_length": (15, "Length of employment", "Employment Length"),
    "home_ownership": (18, "Type of residence", "Home Ownership Status"),
    "annual_inc": (1, "Income insufficient for amount of credit requested", "Annual Income"),
    "verification_status": (17, "Income or employment could not be verified", "Income Verification Status"),
    "purpose": (19, "Purpose of the requested credit", "Loan Purpose"),
    "dti": (2, "Excessive obligations in relation to income", "Debt-to-Income Ratio"),
    "delinq_2yrs": (5, "Delinquent past or present credit obligations", "Delinquencies in Last 2 Years"),
    "inq_last_6mths": (7, "Number of recent inquiries on credit bureau report", "Credit Inquiries in Last 6 Months"),
    "mths_since_last_delinq": (6, "Time since most recent delinquency too short", "Months Since Last Delinquency"),
    "open_acc": (11, "Number of open or established accounts", "Number of Open Accounts"),
    "pub_rec": (13, "Public record information on file", "Public Records"),
    "revol_bal": (10, "Level of revolving account balances", "Revolving Balance"),
    "revol_util": (9, "Proportion of revolving balances to credit limits too high", "Revolving Utilization Rate"),
    "total_acc": (11, "Number of open or established accounts", "Total Number of Accounts"),
    "mort_acc": (12, "Number of mortgage accounts", "Number of Mortgage Accounts"),
    "pub_rec_bankruptcies": (14, "Bankruptcy reported on credit file", "Public Record Bankruptcies"),
    "credit_history_months": (8, "Length of credit history insufficient", "Length of Credit History"),
    "fico_score": (21, "Credit bureau score reflects elevated risk", "FICO Score"),
    "emp_length_missing": (16, "Length of employment not reported", "Employment Length Not Reported"),
    "log_annual_inc": (1, "Income insufficient for amount of credit requested", "Log Annual Income"),
    "loan_to_income": (4, "Amount of credit requested high relative to income", "Loan-to-Income Ratio"),
    "installment_to_income": (3, "Payment burden high relative to income", "Installment-to-Income Ratio"),
    "dti_x_income": (2, "Excessive obligations in relation to income", "Absolute Debt Burden"),
    "grade_numeric": (20, "Assigned credit risk grade", "Credit Grade"),
    "delinq_ever": (5, "Delinquent past or present credit obligations", "Prior Delinquency Flag"),
    "high_utilization": (9, "Proportion of revolving balances to credit limits too high", "High Credit Utilization Flag"),
    "has_mortgage": (12, "Number of mortgage accounts", "Mortgage Account Flag"),
    "has_bankruptcy": (14, "Bankruptcy reported on credit file", "Bankruptcy on Record"),
    "sub_grade_numeric": (20, "Assigned credit risk grade", "Credit Sub-Grade"),
}
