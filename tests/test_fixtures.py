"""Golden values of FIXTURES.md sections 2 and 3 (twelve contracts) and the corpus totals."""

import pytest
from pyspark.sql import functions as F

from fixture_contracts import tables
from slotpack.operators import corpus
from slotpack.plans.analysis import Analysis

# name: (vars, current slots, recommended, current waste, recommended waste, waste M, waste L, order issues)
EXPECTED = {
    "01-Auction": (11, 6, 5, 36, 4, 0, 4, 2),
    "02-VestingSchedule": (10, 7, 5, 66, 2, 2, 2, 1),
    "03-MultiSigWallet": (11, 6, 6, 42, 42, 0, 4, 2),
    "04-Marketplace": (13, 8, 7, 62, 30, 1, 4, 1),
    "05-LendingPool": (16, 9, 9, 46, 46, 0, 5, 1),
    "06-StakingPool": (13, 10, 7, 112, 16, 3, 3, 3),
    "07-Game": (16, 6, 5, 42, 10, 1, 3, 2),
    "08-Voting": (13, 7, 6, 47, 15, 0, 4, 2),
    "09-Subscription": (13, 7, 6, 55, 23, 1, 3, 2),
    "10-Insurance": (15, 8, 7, 61, 29, 0, 5, 2),
}
RECOMMENDED = {
    "01-Auction": "itemId · highestBid · seller+startTime · highestBidder+minIncrement · "
                  "endTime+settled+cancelled+feeRecipient+feeBps",
    "02-VestingSchedule": "totalAmount · released · cliffDuration · beneficiary+startTimestamp+revocable+revoked · "
                          "vestingDuration+revoker+pausePeriods",
    "03-MultiSigWallet": "nonce · minDelay · admin · proposer · threshold+ownerCount+frozen+pendingUpgrade+version+"
                         "feeToken · guardian",
    "04-Marketplace": "totalSales · minListingPrice · maxListingPrice · owner · treasury · platformFeeBps+royaltyBps+"
                      "paymentToken+paused+whitelistEnabled · totalListings+verifier+lastUpdateAt",
    "05-LendingPool": "totalSupplied · totalBorrowed · lastAccrual · admin · oracle · rateModel · "
                      "reserveFactor+liquidationBonus · decimals+paused+collateralToken · "
                      "borrowingEnabled+liquidationsEnabled+maxLTV+cooldownSeconds+rewardsDistributor",
    "06-StakingPool": "totalStaked · rewardRate · lastUpdateTime · stakingToken · rewardToken+startTime · "
                      "endTime+rewardsAdmin+paused+feePct+earlyExitPenaltyBps · periodFinish+rewardPerTokenStored",
    "07-Game": "prizePool · entryFee · gameMaster+round+maxRounds · winner+playerCount+maxPlayers+roundDeadline+"
               "isActive+isPaused · rewardsDistributed+difficulty+feeRecipient+houseEdgeBps+startedAt",
    "08-Voting": "proposalCount · totalVotes · chairperson+votingStart · votingEnd+verifier · finalized+votingType+"
                 "delegationEnabled+proposalThreshold+tokenAddress · quorumNumerator+quorumDenominator",
    "09-Subscription": "priceMonthly · priceYearly · provider · paymentToken+trialDays · graceSeconds+subscriber+"
                       "autoRenew · isTrial+nextBillingAt+discountBps+tier+referrer",
    "10-Insurance": "totalCoverage · totalClaimsPaid · underwriter · insuranceFund · coverageRatioBps+premiumBps+"
                    "paused+autoApproveSmall+riskLevel+oracle+cooldownDays · policyExpirySeconds+claimsManager · "
                    "maxClaimAmount+minClaimAmount",
}


@pytest.fixture(scope="module")
def analysis(spark):
    c, e, s, f = tables(spark)
    return Analysis(c, e, s, f)


def _cid(name):
    return f"synthetic/{name}.sol:{name}"


def test_declared_positions(analysis):
    rows = (analysis.entries.where(F.col("contract_id") == _cid("01-Auction")).orderBy("ordinal")
            .select("slot", "offset").collect())
    assert [f"{r.slot}/{r.offset}" for r in rows] == ["0/0", "1/0", "2/0", "3/0", "4/0", "4/8", "4/16", "4/17",
                                                      "4/18", "5/0", "5/20"]


def test_state_contracts(analysis):
    rep = {r.contract_id: r for r in analysis.report().collect()}
    iss = analysis.issues().groupBy("contract_id", "code", "severity").count().collect()
    counts = {(r.contract_id, r.code, r.severity): r["count"] for r in iss}
    for name, (nv, cs, rs, cw, rw, m, low, order) in EXPECTED.items():
        r = rep[_cid(name)]
        assert (r.n_vars, r.current_slots, r.recommended_slots, r.current_wasted, r.recommended_wasted) == \
            (nv, cs, rs, cw, rw), name
        assert counts.get((_cid(name), "PARTIAL_SLOT_WASTE", "MEDIUM"), 0) == m, name
        assert counts.get((_cid(name), "PARTIAL_SLOT_WASTE", "LOW"), 0) == low, name
        assert counts.get((_cid(name), "SUBOPTIMAL_ORDER", "MEDIUM"), 0) == order, name
        assert r.strategy.startswith("DP") and r.status == "OK"


def test_recommended_slot_contents(analysis):
    slots = analysis.recommended_slots().collect()
    by = {}
    for r in sorted(slots, key=lambda r: (r.contract_id, r.slot_index)):
        by.setdefault(r.contract_id, []).append(r.labels.replace(",", "+"))
    for name, text in RECOMMENDED.items():
        assert " · ".join(by[_cid(name)]) == text, name


def test_struct_contracts(analysis):
    rep = {r.contract_id: r for r in analysis.report().collect()}
    so = {r.contract_id: r for r in analysis.struct_optimization().collect()}
    loan, acct = _cid("11-StructLoan"), _cid("12-StructAccount")
    assert (rep[loan].current_slots, rep[loan].recommended_slots, rep[loan].current_wasted, rep[loan].n_issues) == (9, 9, 0, 0)
    assert (rep[acct].current_slots, rep[acct].recommended_slots, rep[acct].current_wasted, rep[acct].n_issues) == (14, 14, 0, 0)
    assert (so[loan].current_slots, so[loan].optimal_slots, so[loan].direct_instances, so[loan].total_saved_slots) == (3, 2, 3, 3)
    assert (so[acct].current_slots, so[acct].optimal_slots, so[acct].direct_instances, so[acct].total_saved_slots) == (7, 4, 2, 6)
    n = analysis.recommended_slots().groupBy("contract_id").count().collect()
    rows = {r.contract_id: r["count"] for r in n}
    assert rows[loan] == 3 and rows[acct] == 2  # Q4: one row per variable wider than a slot


def test_corpus_totals(analysis):
    rows = analysis.bulk_rows()
    s = corpus.bulk_summary(rows).collect()[0]
    d = corpus.dataset_report(rows).collect()[0]
    assert (s.contracts_ok, s.contracts_error, s.saved_slots, s.struct_saved_slots) == (12, 0, 11, 9)
    assert (s.strategy_exact, s.strategy_ffd, s.structs_total, s.structs_improved) == (12, 0, 2, 2)
    assert (d.total_saved_slots, d.total_saved_bytes, d.winners, d.winners_pct, d.gas_saved) == (20, 352, 10, 83.3, 400000)
    assert d.synthetic_count == 12 and d.real_count == 0
