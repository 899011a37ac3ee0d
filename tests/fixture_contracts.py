"""The twelve hand-written contracts of FIXTURES.md (declared order, types), as layout tables."""

from pyspark.sql import functions as F

from slotpack.functions import nextfit

SIZES = {"bool": 1, "address": 20, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "uint96": 12,
         "uint128": 16, "uint256": 32}

STATE = {
    "01-Auction": "seller:address itemId:uint256 highestBidder:address highestBid:uint256 startTime:uint64 "
                  "endTime:uint64 settled:bool cancelled:bool minIncrement:uint96 feeRecipient:address feeBps:uint16",
    "02-VestingSchedule": "beneficiary:address totalAmount:uint256 released:uint256 startTimestamp:uint64 "
                          "cliffDuration:uint256 vestingDuration:uint64 revocable:bool revoked:bool revoker:address "
                          "pausePeriods:uint32",
    "03-MultiSigWallet": "admin:address nonce:uint256 proposer:address threshold:uint8 ownerCount:uint8 "
                         "minDelay:uint256 guardian:address frozen:bool pendingUpgrade:bool version:uint16 "
                         "feeToken:address",
    "04-Marketplace": "owner:address treasury:address totalSales:uint256 platformFeeBps:uint16 royaltyBps:uint16 "
                      "paymentToken:address minListingPrice:uint256 maxListingPrice:uint256 paused:bool "
                      "whitelistEnabled:bool totalListings:uint32 verifier:address lastUpdateAt:uint64",
    "05-LendingPool": "admin:address oracle:address rateModel:address totalSupplied:uint256 totalBorrowed:uint256 "
                      "reserveFactor:uint128 liquidationBonus:uint128 lastAccrual:uint256 decimals:uint8 paused:bool "
                      "borrowingEnabled:bool liquidationsEnabled:bool collateralToken:address maxLTV:uint16 "
                      "cooldownSeconds:uint64 rewardsDistributor:address",
    "06-StakingPool": "stakingToken:address rewardToken:address totalStaked:uint256 startTime:uint64 "
                      "rewardRate:uint256 endTime:uint64 lastUpdateTime:uint256 rewardsAdmin:address "
                      "periodFinish:uint128 rewardPerTokenStored:uint128 paused:bool feePct:uint8 "
                      "earlyExitPenaltyBps:uint16",
    "07-Game": "gameMaster:address prizePool:uint256 winner:address round:uint8 maxRounds:uint8 playerCount:uint8 "
               "maxPlayers:uint8 entryFee:uint256 roundDeadline:uint64 isActive:bool isPaused:bool "
               "rewardsDistributed:bool difficulty:uint16 feeRecipient:address houseEdgeBps:uint8 startedAt:uint64",
    "08-Voting": "chairperson:address proposalCount:uint256 votingStart:uint64 votingEnd:uint64 finalized:bool "
                 "verifier:address quorumNumerator:uint128 quorumDenominator:uint128 totalVotes:uint256 "
                 "votingType:uint8 delegationEnabled:bool proposalThreshold:uint16 tokenAddress:address",
    "09-Subscription": "provider:address paymentToken:address priceMonthly:uint256 trialDays:uint32 "
                       "graceSeconds:uint64 priceYearly:uint256 subscriber:address autoRenew:bool isTrial:bool "
                       "nextBillingAt:uint64 discountBps:uint16 tier:uint8 referrer:address",
    "10-Insurance": "underwriter:address insuranceFund:address totalCoverage:uint256 coverageRatioBps:uint16 "
                    "premiumBps:uint16 policyExpirySeconds:uint64 claimsManager:address totalClaimsPaid:uint256 "
                    "paused:bool autoApproveSmall:bool maxClaimAmount:uint128 minClaimAmount:uint128 riskLevel:uint8 "
                    "oracle:address cooldownDays:uint32",
}
STRUCTS = {
    "11-StructLoan": ("Loan", "borrower:address amount:uint256 deadline:uint64 active:bool", ["loanA", "loanB", "loanC"]),
    "12-StructAccount": ("Account", "a:uint64 big1:uint256 b:uint64 big2:uint256 c:uint64 big3:uint256 d:uint64",
                         ["accountX", "accountY"]),
}


def _parse(spec):
    return [tuple(x.split(":")) for x in spec.split()]


def tables(spark):
    """contracts, entries, structs, struct_fields of the twelve contracts (positions by the sequential rule)."""
    contracts, raw, fields, structs = [], [], [], []
    names = list(STATE) + list(STRUCTS)
    for i, name in enumerate(names):
        cid = f"synthetic/{name}.sol:{name}"
        contracts.append((f"synthetic/{name}.sol", f"synthetic/{name}.sol", name.split("-", 1)[1], 0, 0, cid))
        if name in STATE:
            for o, (label, typ) in enumerate(_parse(STATE[name])):
                raw.append((cid, o, label, f"t_{typ}", SIZES[typ], typ, "inplace"))
        else:
            sname, fspec, insts = STRUCTS[name]
            tid = f"t_struct({sname})_storage"
            members = _parse(fspec)
            pos, u, s = [], 0, 0
            for label, typ in members:  # member positions by the same rule
                b = SIZES[typ]
                if b >= 32:
                    s, u = s + (1 if u else 0), 0
                    pos.append((s, 0))
                    s += (b + 31) // 32
                else:
                    if u + b > 32:
                        s, u = s + 1, 0
                    pos.append((s, u))
                    u += b
                    if u == 32:
                        s, u = s + 1, 0
            nslots = s + (1 if u else 0)
            for o, ((label, typ), (sl, off)) in enumerate(zip(members, pos)):
                fields.append((cid, tid, o, label, f"t_{typ}", typ, SIZES[typ], "inplace", sl, off))
            structs.append((cid, 0, tid, f"struct {sname}", nslots * 32))
            for o, inst in enumerate(insts):
                raw.append((cid, o, inst, tid, nslots * 32, f"struct {sname}", "inplace"))
    c = spark.createDataFrame(contracts, "file string, source_unit string, contract_name string, source_ord int, "
                                         "contract_ord int, contract_id string")
    r = spark.createDataFrame(raw, "contract_id string, ordinal int, label string, type_id string, "
                                   "number_of_bytes int, type_label string, encoding string")
    p = nextfit.positions(r, ["contract_id"], "ordinal", "number_of_bytes")
    e = (r.join(p.withColumn("ordinal", F.col("ordinal").cast("int")), ["contract_id", "ordinal"])
         .select("contract_id", "ordinal", F.col("ordinal").alias("ast_id"), F.col("contract_id").alias("contract"),
                 "label", F.col("offset").cast("int").alias("offset"), F.col("slot").cast("string").alias("slot_text"),
                 F.col("slot").cast("bigint").alias("slot"), "type_id", "number_of_bytes", "type_label", "encoding"))
    f = spark.createDataFrame(fields, "contract_id string, type_id string, ordinal int, label string, "
                                      "member_type_id string, type_label string, number_of_bytes int, "
                                      "encoding string, slot int, offset int")
    s = spark.createDataFrame(structs, "contract_id string, struct_ord int, type_id string, label string, "
                                       "number_of_bytes int")
    return c, e, s, f
