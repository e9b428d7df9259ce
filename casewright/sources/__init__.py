"""casewright.sources"""
