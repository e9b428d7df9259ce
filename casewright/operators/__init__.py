"""casewright.operators"""
