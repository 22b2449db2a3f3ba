"""Schemas of the tables, as DDL."""

BOOKS_RAW = "instId string, price string, size string, numOrders bigint, side string, timestamp bigint, prevSeqId bigint, seqId bigint, action string, checksum bigint"
BOOKS = "instId string, timestamp bigint, seq bigint, side string, price double, size double, numOrders bigint, action string"
TRADES = "instId string, timestamp bigint, tradeId bigint, px double, sz double, side string"
INDICATOR = "measurement string, exchange string, instId string, instType string, level string, side string, ts timestamp, val double"

_LEVELS = "array<array<string>>"
#: Message shapes by channel: what each file's data array holds.
MESSAGES = {
    "books": f"struct<arg:struct<instId:string>,action:string,data:array<struct<ts:string,checksum:bigint,prevSeqId:bigint,seqId:bigint,asks:{_LEVELS},bids:{_LEVELS}>>>",
    "trades": "struct<data:array<struct<instId:string,ts:string,tradeId:string,px:string,sz:string,side:string>>>",
    "tickers": "struct<data:array<struct<instType:string,instId:string,ts:string,last:string,lastSz:string,askPx:string,askSz:string,bidPx:string,bidSz:string,open24h:string,high24h:string,low24h:string,volCcy24h:string,vol24h:string,sodUtc0:string,sodUtc8:string>>>",
    "open_interest": "struct<data:array<struct<instType:string,instId:string,ts:string,oi:string,oiCcy:string>>>",
    "mark_price": "struct<data:array<struct<instType:string,instId:string,ts:string,markPx:string>>>",
    "liquidations": "struct<data:array<struct<instType:string,instId:string,uly:string,details:array<struct<side:string,posSide:string,bkPx:string,sz:string,bkLoss:string,ccy:string,ts:string>>>>>",
    "index_tickers": "struct<arg:struct<instId:string>,data:array<struct<ts:string,idxPx:string,high24h:string,low24h:string,open24h:string,sodUtc0:string,sodUtc8:string>>>",
}
