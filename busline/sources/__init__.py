"""busline.sources"""
